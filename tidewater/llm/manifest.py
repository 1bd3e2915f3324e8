"""Merkle manifest of a dataset: a proof for every row, by a butterfly exchange between blocks of leaves.

Rows are numbered within their tree (a language) and dealt into aligned blocks of fanout ** depth leaves. Each block
hashes its own subtree. Then, round by round, the blocks of aligned groups of fanout subtrees swap those subtrees'
roots: in round r a block asks one block of each sibling subtree of fanout ** r blocks, hashes the parent by itself
and appends the siblings to its upper proof. All blocks under a node hash it, so that after the last round every
block holds the root and the upper part of its rows' proofs, and nothing has to be sent down again. Roots of the
trees are leaves of one more tree of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, if_small, prepare, saved

FANOUT = 2
#: Levels of the tree within a block: 1,024 leaves with a fanout of 2.
DEPTH = 10
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(values: list[Column]) -> Column:
    """Hex digest of the values, each as its UTF-8 byte count, a colon and its text; `-` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def parent(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a node's siblings lead to; a step has the digests left and right of the node."""
    for left, right in steps:
        node = parent(left, node, right)
    return node


def subtree(leaves: list[str], fanout: int, depth: int | None) -> list[list[str]]:
    """Levels of a tree from its leaves up: to its only node, or exactly `depth` levels above the leaves."""
    levels = [leaves]
    while len(levels) - 1 < depth if depth is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([parent(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def steps_of(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """Siblings left and right of a leaf and its ancestors, below the last level."""
    found = []
    for level in levels[:-1]:
        first = at - at % fanout
        found.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return found


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows (saved) with `rank`, from 0 within each tree by `order`, which leaves no ties, and `size`, the tree's rows.

    Rows are sorted by range, so a tree may hold any share of them; only counts per range and tree are gathered.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the number has the range in its upper 31 bits and the row's place there in the lower 33
    dealt = saved(rows.repartitionByRange(n, tree, *order).sortWithinPartitions(tree, *order).withColumn("_m", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_m", 33))
    parts = saved(dealt.groupBy(tree, "_range").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")))
    before = Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("size", F.sum("_n").over(Window.partitionBy(tree)))
    parts = if_small(saved(parts.select(tree, "_range", "_first", "_before", "size")), 100_000)
    return dealt.join(parts, [tree, "_range"]).withColumn("rank", F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_range", "_first", "_before")


def _by_block(rows: DataFrame, leaves: int) -> DataFrame:
    """rows (tree, rank, ...) with `block`, each block's rows together and in order."""
    rows = rows.withColumn("block", F.floor(F.col("rank") / F.lit(leaves)).cast("long"))
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), rows) for rows that come sorted by both; a block's rows are held at once."""
    key, held = None, []
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def block_proofs(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(tree, block, node, steps): each block with its tree's root and the siblings above the block.

    nodes: (tree, rank, size, leaf), saved, with a hex digest as leaf. Rounds grow with the logarithm of the largest
    tree's blocks; each is a join of one row a block, saved to the shared folder.
    """
    prepare(nodes.sparkSession)
    leaves = fanout**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _groups(batches, ["tree", "block", "size", "leaf"]):
            size = rows[0][0]
            top = subtree([r[1] for r in rows], fanout, depth if size > leaves else None)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([block], pa.int64()), pa.array([-(-size // leaves)], pa.int64()), pa.array([top])], ["tree", "block", "blocks", "node"])

    found = _by_block(nodes.select("tree", "rank", "size", "leaf"), leaves).mapInArrow(freeing(run), "tree string, block long, blocks long, node string")
    state = saved(found.withColumn("steps", F.array().cast(_STEPS)))
    most = state.agg(F.max("blocks")).first()[0] or 1
    span = 1  # blocks under a node of this round
    while span < most:
        state = saved(_swap(state, fanout, span))
        span *= fanout
    return state


def _swap(state: DataFrame, fanout: int, span: int) -> DataFrame:
    """One round: every block gets the nodes beside its own from a block under each, and hashes the node above.

    Blocks of trees that have come to their root stay as they are. Asked blocks are dealt evenly over the sibling's
    span, so none is asked by more than fanout times the blocks that it has beside it.
    """
    own = F.floor(F.col("block") / F.lit(span)).cast("long")
    first = own - own % F.lit(fanout)
    going = state.filter(F.col("blocks") > span).withColumns({"_own": own, "_first": first, "_nodes": F.ceil(F.col("blocks") / F.lit(span)).cast("long")})
    last = F.least(F.col("_first") + F.lit(fanout - 1), F.col("_nodes") - 1)
    asks = going.select("tree", "block", "blocks", "_own", F.explode(F.sequence(F.col("_first"), last)).alias("_asked")).filter("_asked <> _own")
    under = F.least(F.lit(span), F.col("blocks") - F.col("_asked") * F.lit(span))
    asks = asks.withColumn("_from", (F.col("_asked") * F.lit(span) + (F.col("block") % F.lit(span)) % under).cast("long"))
    sent = state.select("tree", F.col("block").alias("_from"), F.col("node").alias("_node"))
    got = asks.join(sent, ["tree", "_from"]).groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct("_asked", "_node"))).alias("_got"))  # fanout - 1 at most

    def side(condition: Column) -> Column:
        return F.array_join(F.transform(F.filter("_got", lambda x: condition(x)), lambda x: x["_node"]), "")

    full = going.join(got, ["tree", "block"], "left").withColumn("_got", F.coalesce("_got", F.array().cast(got.schema["_got"].dataType)))
    step = F.struct(side(lambda x: x["_asked"] < F.col("_own")).alias("left"), side(lambda x: x["_asked"] > F.col("_own")).alias("right"))
    full = full.withColumn("_step", step)
    done = full.select(
        "tree", "block", "blocks", F.sha2(F.concat("_step.left", "node", "_step.right"), 256).alias("node"), F.concat("steps", F.array("_step")).alias("steps")
    )
    return done.unionByName(state.filter(F.col("blocks") <= span))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: (doc_id, source, lang, n_chars, text). Trees are languages, null first and then by UTF-8 bytes; leaves go by
    doc_id, null first, and equal doc_ids by their leaves, so repeated rows are leaves of their own beside each other.
    tampered: the value of n_chars to verify with, where it isn't null; without it each row verifies its own leaf.
    proof_sha256 is the digest of all siblings on the way up. Nulls are marked in the leaf, empty texts aren't nulls;
    other columns are left out; no rows give no rows.
    """
    prepare(docs.sparkSession)
    values = [docs[c] for c in COLUMNS]
    doc_id = docs["doc_id"].cast("long")
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_hash([tampered if c == "n_chars" else docs[c] for c in COLUMNS]))
    rows = docs.select(
        doc_id.alias("doc_id"), leaf_hash(values).alias("leaf"), changed.alias("changed"), F.when(docs["lang"].isNull(), "").otherwise(F.concat(F.lit("="), docs["lang"].cast("string"))).alias("tree")
    )
    # a row number that is written once tells equal rows apart
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()))
    some = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_some", F.col("doc_id").isNotNull())
    nodes = saved(numbered(some, "tree", ["_some", "_key", "leaf", "_row"]).select("doc_id", "leaf", "changed", "tree", "rank", "size"))
    lower = block_proofs(nodes, fanout, depth)
    subroots = saved(lower.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("node").alias("leaf")))
    top = saved(numbered(subroots, "tree", ["name"]))
    upper = block_proofs(top, fanout, depth)
    crowns = saved(_with_steps(top, upper, ["name", "leaf"], fanout, depth, "name string, subroot string, root string, crown " + _STEPS))
    blocks = lower.join(if_small(crowns.withColumnRenamed("name", "tree"), 20_000), "tree").select("tree", "block", "subroot", "root", F.concat("steps", "crown").alias("steps"))
    return _verified(nodes, saved(blocks), fanout, depth)


def _with_steps(nodes: DataFrame, blocks: DataFrame, columns: list[str], fanout: int, depth: int, schema: str) -> DataFrame:
    """Each node of a tree with the root and all its siblings up to there. One row a tree below, so it is small beside the rows."""
    leaves = fanout**depth
    above = blocks.select("tree", "block", F.col("node").alias("root"), "steps")
    rows = _merged(nodes, above, ["size", *columns], ["root", "steps"], leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, ["tree", "block", "root", "steps", "size", *columns]):
            (root, steps, *_), own = held[0], [r[2:] for r in held[1:]]
            levels = subtree([r[2] for r in own], fanout, depth if own[0][0] > leaves else None)
            crowns = [[{"left": a, "right": b} for a, b in steps_of(levels, i, fanout)] + steps for i in range(len(own))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in own]), pa.array([r[2] for r in own]), pa.array([root] * len(own)), pa.array(crowns, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], ["name", "subroot", "root", "crown"]
            )

    return rows.mapInArrow(freeing(run), schema)


def _merged(nodes: DataFrame, above: DataFrame, columns: list[str], upper: list[str], leaves: int) -> DataFrame:
    """A block's row of `above` and then its nodes, all in one place: one shuffle, and no join of wide rows."""
    own = nodes.select("tree", F.floor(F.col("rank") / F.lit(leaves)).cast("long").alias("block"), "rank", *[F.lit(None).cast(above.schema[c].dataType).alias(c) for c in upper], *columns)
    head = above.select("tree", "block", F.lit(-1).cast("long").alias("rank"), *upper, *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns])
    return head.unionByName(own).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")


def _verified(nodes: DataFrame, blocks: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Each row with its proof's digest and the root that its (changed) leaf and its siblings lead to."""
    leaves = fanout**depth
    rows = _merged(nodes, blocks, ["size", "doc_id", "leaf", "changed"], ["subroot", "root", "steps"], leaves)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, ["tree", "block", "subroot", "root", "steps", "size", "doc_id", "leaf", "changed"]):
            (subroot, root, upper, *_), own = held[0], [r[3:] for r in held[1:]]
            levels = subtree([r[2] for r in own], fanout, depth if own[0][0] > leaves else None)
            above = [(s["left"], s["right"]) for s in upper]
            proofs, folded = [], []
            for i, (_, _, leaf, changed) in enumerate(own):
                steps = steps_of(levels, i, fanout) + above
                proofs.append(parent(*(x for step in steps for x in step)))
                folded.append(fold(changed or leaf, steps))
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in own], pa.int64()), pa.array([r[2] for r in own]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], names
            )

    return rows.mapInArrow(freeing(run), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document by its checksum is verified with one character more than it has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    wrong = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    return manifest(docs, wrong)


#: Levels of pairs in the SQL: trees of up to 2 ** 34 leaves.
_LEVELS = 34


def _crc32_table() -> list[int]:
    """The checksum's 256 remainders, from its polynomial."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return table


def crc32_sql(of: str) -> str:
    """SQL for the unsigned CRC-32 of a list of bytes; `t` of crc_table must be in scope."""
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {of}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255::UBIGINT)::INT + 1])), 4294967295::UBIGINT)"


CRC_TABLE = f"crc_table AS (SELECT {_crc32_table()}::UBIGINT[] AS t)"


def _op11_sql() -> str:
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(n if c == "n_chars" else value(c) for c in COLUMNS) + ")"
    crc = crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)")
    out = [CRC_TABLE, f"d AS (SELECT documents.*, {crc} % 7 = 0 AS wrong FROM documents, crc_table)"]
    out.append(f"l AS (SELECT doc_id, lang, {leaf(value('n_chars'))} AS leaf, CASE WHEN wrong THEN {leaf(value('(n_chars + 1)'))} END AS changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM d)")

    def climb(name: str, start: str, key: str) -> None:
        """Nodes (key, i, h, n) of all levels, as name0, name1, ...: a tree of one node stays as it is."""
        out.append(f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM ({start}))")
        for k in range(1, _LEVELS + 1):
            p = f"{name}{k - 1}"
            out.append(
                f"{name}{k} AS MATERIALIZED (SELECT {key}, i // 2 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 1) // 2 AS n FROM {p} GROUP BY {key}, i // 2)"
            )

    climb("a", "SELECT lang, i, leaf AS h FROM l", "lang")
    climb("b", f"SELECT 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h FROM a{_LEVELS}", "one")
    for name, levels, key in (("pa", "a", "lang"), ("pb", "b", "one")):
        sides = " UNION ALL ".join(f"SELECT {key}, {k} AS k, i, i // 2 AS up, h, n FROM {levels}{k}" for k in range(_LEVELS))
        out.append(f"{name} AS MATERIALIZED ({sides})")
    steps = []
    steps.append(f"sa AS (SELECT l.doc_id, l.lang, l.i, pa.k, pa.i < (l.i >> pa.k) AS first, pa.h FROM l JOIN pa ON pa.lang IS NOT DISTINCT FROM l.lang AND pa.up = l.i >> (pa.k + 1) AND pa.i <> l.i >> pa.k)")
    steps.append(f"sb AS (SELECT r.lang, pb.k + {_LEVELS} AS k, pb.i < (r.i >> pb.k) AS first, pb.h FROM (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM a{_LEVELS}) r JOIN pb ON pb.up = r.i >> (pb.k + 1) AND pb.i <> r.i >> pb.k)")
    out += steps
    # a level without a sibling counts too while the tree has more than one node there
    out.append("na AS (SELECT DISTINCT lang, k FROM pa WHERE n > 1)")
    out.append(f"nb AS (SELECT DISTINCT k + {_LEVELS} AS k FROM pb WHERE n > 1)")
    out.append("lv AS (SELECT l.lang, l.i, na.k FROM l JOIN na ON na.lang IS NOT DISTINCT FROM l.lang UNION ALL SELECT l.lang, l.i, nb.k FROM l, nb)")
    out.append("st AS (SELECT lang, i, k, first, h FROM sa UNION ALL SELECT l.lang, l.i, sb.k, sb.first, sb.h FROM l JOIN sb ON sb.lang IS NOT DISTINCT FROM l.lang)")
    out.append(
        "ls AS (SELECT lv.lang, lv.i, list({'l': CASE WHEN st.first THEN st.h ELSE '' END, 'r': CASE WHEN NOT st.first THEN st.h ELSE '' END} ORDER BY lv.k) AS steps"
        " FROM lv LEFT JOIN st ON st.lang IS NOT DISTINCT FROM lv.lang AND st.i = lv.i AND st.k = lv.k GROUP BY ALL)"
    )
    out.append("f AS (SELECT l.*, list_transform(coalesce(steps, []), lambda s: {'l': coalesce(s.l, ''), 'r': coalesce(s.r, '')}) AS steps FROM l LEFT JOIN ls ON ls.lang IS NOT DISTINCT FROM l.lang AND ls.i = l.i)")
    folded = "list_reduce(list_concat([{'l': '', 'r': coalesce(changed, leaf)}], steps), lambda a, s: {'l': '', 'r': sha256(s.l || a.r || s.r)}).r"
    proof = "sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.l || s.r), ''), ''))"
    out.append(f"g AS (SELECT f.*, {folded} AS folded_root, {proof} AS proof_sha256 FROM f)")
    return (
        "WITH "
        + ",\n".join(out)
        + f"\nSELECT doc_id, leaf, a.h AS subroot, b.h AS root, proof_sha256, folded_root, folded_root = b.h AS verified FROM g JOIN a{_LEVELS} a ON a.lang IS NOT DISTINCT FROM g.lang CROSS JOIN b{_LEVELS} b"
    )


OP11_SQL = _op11_sql()
