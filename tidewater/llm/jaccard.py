"""N-gram Jaccard join: exact links between documents whose shingle sets are alike.

1. Equal shingle sets become one class, known by its smallest doc_id.
2. A cheap round links classes to leaders: those that share most of the least hashes in their sets, verified.
3. The exact round deals each set's prefix (the part that a similar set must meet, rare shingles first) by
   shingle, in order of size. Rows of a shingle that very many documents hold are split into blocks, and each pair
   of blocks is a task's work of its own. Pairs from different components of round 2 are counted; the count and
   what lies beyond the prefixes bound the overlap, and pairs under the bound go.
4. Verification deals pairs into tiles of one leader. Hashed bitmaps of both sets bound the overlap from above by
   bit counts, and only pairs that pass have their sorted arrays intersected.

Shingles that very many documents share are found in a first pass and put last in the order of prefixes, so
common passages don't make pairs. That list only chooses an order: links are exact whatever it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, components, freeing, if_small, prepare, saved, windows, word_hashes, words

#: Shingles put last in prefixes: at most so many, each in at least so many documents.
COMMON_SHINGLES, COMMON_FROM = 200_000, 12
#: Least hashes that the cheap round compares, and how many must agree.
SKETCH, SKETCH_AGREE = 6, 3
TILE_ROWS = 2_000
#: A shingle in more documents than this has its rows split into blocks of about so many.
BLOCK_ROWS = 20_000
BITS = 2048


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, A-Z folded; few words count as one shingle."""
    for first, last, data, offsets in chunks(column):
        starts, ends, at = words(data, offsets)
        h = word_hashes(data, starts, ends, fold=True)
        w = windows(h, k)
        for i in range(last - first):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield np.unique(w[a : b - k + 1])
            elif b > a:
                yield windows(h[a:b], int(b - a)) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def _ordered(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the order of prefixes (common shingles last, else by hash) and how many of it aren't common."""
    if not len(common):
        return s, len(s)
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~late], s[late]]), int((~late).sum())


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), _signed(flat.astype(np.uint64)))


def common_shingles(docs: DataFrame, k: int, most: int = COMMON_SHINGLES, least: int = COMMON_FROM) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in about `least` documents or more, the `most` most frequent at most, and in how many; counted over all documents.

    Each task counts all its documents and reports what occurs in at least three of them and a thousandth of a
    batch; the reports are summed by Spark. A shingle missed here costs time, not links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []
        size = 0

        def merge() -> None:
            nonlocal held_k, held_n, pending, size
            k_, n_ = np.unique(np.concatenate(pending), return_counts=True) if pending else (held_k[:0], held_n[:0])
            keys = np.concatenate([held_k, k_[n_ >= 2]])
            held_k, inverse = np.unique(keys, return_inverse=True)
            held_n = np.bincount(inverse, np.concatenate([held_n, n_[n_ >= 2]]), len(held_k)).astype(np.int64)
            if len(held_k) > 4 * most:
                top = np.sort(np.argpartition(-held_n, 4 * most)[: 4 * most])
                held_k, held_n = held_k[top], held_n[top]
            pending, size = [], 0

        for b in batches:
            for s in shingle_sets(b.column(0), k):
                pending.append(s)
                size += len(s)
                if size > 2_000_000:
                    merge()
        merge()
        ok = held_n >= 3
        if ok.any():
            yield pa.RecordBatch.from_arrays([_signed(held_k[ok]), pa.array(held_n[ok])], ["s", "n"])

    found = saved(docs.select("text").mapInArrow(freeing(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    # the counts' spread tells which ones to take, so that no more than `most` come to the driver
    spread = found.groupBy(F.floor(F.log2("n") * 16).alias("g")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("g")).collect()
    total, from_ = 0, None
    for row in spread:  # sixteen a doubling
        total += row["c"]
        if total > most:
            break
        from_ = row["n"]
    if from_ is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = found.filter(F.col("n") >= from_).select("s", "n").toArrow()
    keys = rows["s"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy()[order]


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets link, by tiles of one leader a. nodes: (node, set_key)."""
    counts = if_small(saved(pairs.groupBy("a").agg(F.count("*").alias("_n"))))
    tiles = pairs.join(counts, "a").withColumn("_tile", F.pmod(F.hash("b"), F.ceil(F.col("_n") / TILE_ROWS).cast("int")))
    wanted = tiles.select("a", "_tile", F.col("b").alias("node"), F.lit(1).alias("member"))
    wanted = wanted.unionByName(tiles.select("a", "_tile", F.col("a").alias("node"), F.lit(0).alias("member")).distinct())
    wanted = saved(wanted.join(nodes, "node"))
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    rows = texts.join(if_small(wanted), "node").select("a", "_tile", "member", "node", "set_key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, arrays = [], []
            for i, (s, key) in enumerate(zip(shingle_sets(b.column(5), k), b.column(4).to_pylist())):
                if _set_key(s) == key:  # a row of the same doc_id with another text is another set
                    keep.append(i)
                    arrays.append(s.tobytes())
            if keep:
                part = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(arrays, pa.binary())], ["a", "_tile", "member", "node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = tile = None
        for b in batches:
            out = []
            for a, t, member, node, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                s = np.frombuffer(raw, np.uint64)
                bits = _bitmap(s)
                if member == 0:
                    leader, tile, lset, lbits = a, t, s, bits
                    continue
                if (leader, tile) != (a, t):
                    raise ValueError(f"node {node} is to be compared with node {a}, whose text wasn't found: was the table changed while it was read?")
                need = -(-percent * (len(s) + len(lset)) // (100 + percent))
                # each shared shingle sets a shared bit; a set's other shingles can hide behind few bits
                hidden = min(len(s) - _ones(bits), len(lset) - _ones(lbits))
                if min(len(s), len(lset)) < need or _ones(bits & lbits) + hidden < need:
                    continue
                if len(np.intersect1d(s, lset, assume_unique=True)) >= need:
                    out.append((a, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    arrays = rows.mapInArrow(freeing(sets), "a long, _tile int, member int, node long, shingles binary")
    arrays = arrays.repartition("a", "_tile").sortWithinPartitions("a", "_tile", "member", "node")
    return arrays.mapInArrow(freeing(compare), "a long, b long")


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(s % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link where 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id that links reach, the document's own included. Null and empty texts have no shingles and
    link with nothing. Repeated rows link with each other; rows of one doc_id with different texts count as one
    document in links. A row with a null doc_id takes the component of documents with the same set, else null.
    Other columns are left out; no rows give no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common, common_n = common_shingles(docs, k)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, own, keys, sketch, prefix = [], [], [], [], []
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                sketch.append(s[:SKETCH])
                ordered, rare = _ordered(s, common)
                own.append(rare)
                prefix.append(ordered[: len(s) - -(-percent * len(s) // 100) + 1] if len(s) else s)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(keys, pa.binary()), _lists(sketch), _lists(prefix)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "rare", "set_key", "sketch", "prefix"])

    signed = docs.mapInArrow(freeing(signatures), "doc_id long, n_shingles long, rare long, set_key binary, sketch array<long>, prefix array<long>")
    signed = saved(signed)
    rows = signed.select("doc_id", "n_shingles", "set_key")
    classes = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "rare", "sketch", "prefix")).alias("r"))
    classes = saved(classes.select("set_key", F.col("r.doc_id").alias("node"), F.col("r.n_shingles").alias("n"), "r.rare", "r.sketch", "r.prefix"))
    nodes = classes.select("node", "set_key")

    # the cheap round: leaders of sketch hashes
    sketched = classes.select("node", "n", F.explode("sketch").alias("h"))
    leaders = sketched.groupBy("h").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("c")).filter("c > 1").select("h", F.col("lead.node").alias("a"), F.col("lead.n").alias("an"))
    stars = sketched.join(saved(leaders), "h").filter("node <> a and 100 * least(n, an) >= %d * greatest(n, an)" % percent)
    stars = stars.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("n", "an")).alias("small"))
    stars = saved(stars.filter(F.col("c") >= F.least(F.lit(SKETCH_AGREE), F.col("small"))).select("a", "b"))
    links = saved(_verified(docs, stars, nodes, k, percent))
    first = saved(components(links))

    # the exact round: prefixes, between components of the first
    labelled = classes.join(first, "node", "left").select("node", "n", "rare", F.coalesce("component", "node").alias("component"), "prefix")
    dealt = labelled.select(F.posexplode("prefix").alias("i", "h"), "node", F.col("n").cast("int").alias("n"), F.col("rare").cast("int").alias("rare"), "component")
    dealt = _in_blocks(dealt, common, common_n).repartition("h", "cell").sortWithinPartitions("h", "cell", "n", "node")

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # batches of the last hash and cell so far, put together once
        for b in batches:
            if not b.num_rows:
                continue
            block = np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(8)])
            if held and (block[-1, :2] == held[0][0, :2]).all():
                held.append(block)
                continue
            block = np.concatenate([*held, block])
            cut = int(np.flatnonzero((block[:, :2] == block[-1, :2]).all(1))[0])
            held = [block[cut:]]
            yield from _cross_pairs(block[:cut], percent)
        if held:
            yield from _cross_pairs(np.concatenate(held), percent)

    pairs = dealt.mapInArrow(freeing(pair_up), "a long, b long, rare int, an int, bn int, ar int, br int")
    pairs = pairs.groupBy("a", "b", "an", "bn", "ar", "br").agg(F.sum("rare").alias("met"))
    pairs = saved(pairs.filter(_may_link(percent)).select("a", "b"))
    more = _verified(docs, pairs, nodes, k, percent)
    joined = components(saved(links.unionByName(more)))

    found = classes.select("set_key", "node").join(joined, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    return rows.join(found, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _in_blocks(dealt: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Rows (h, cell, node, n, component, i, rare, block). Two rows of a shingle meet in one cell, just once.

    A shingle that `counts` says is in more than BLOCK_ROWS documents has its rows in blocks by node. A cell stands
    for two blocks, whose rows are compared across (block tells them apart), or for one (block is -1).
    """
    rows = ["h", "cell", "node", "n", "component", "i", "rare", "block"]
    heavy = counts > BLOCK_ROWS
    if not heavy.any():
        return dealt.withColumns({"cell": F.lit(0), "block": F.lit(-1)}).select(rows)
    many = -(-counts[heavy] // BLOCK_ROWS)
    table = dealt.sparkSession.createDataFrame(list(zip(common[heavy].view(np.int64).tolist(), many.tolist())), "h long, blocks long")  # COMMON_SHINGLES rows at most
    dealt = dealt.join(F.broadcast(table), "h", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("long"))
    none = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(-1).cast("long").alias("block")))
    # cells are numbered by their two blocks
    each = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda j: F.struct((F.least("own", j) * F.col("blocks") + F.greatest("own", j)).alias("cell"), F.when(F.col("own") == j, F.lit(-1).cast("long")).otherwise(F.col("own")).alias("block")),
    )
    dealt = dealt.withColumn("c", F.explode(F.when(F.col("blocks").isNull(), none).otherwise(each)))
    return dealt.withColumns({"cell": F.col("c.cell"), "block": F.col("c.block")}).select(rows)


def _prefix(n, percent: int, pair: bool = False):
    """Length of the prefix that a set must share a shingle of with a similar set; shorter (pair) for the smaller of two."""
    need = -(-2 * percent * n // (100 + percent)) if pair else -(-percent * n // 100)
    return n - need + 1


def _may_link(percent: int) -> Column:
    """Whether the overlap of a (smaller) and b can suffice. met: rare shingles of a's short prefix found in b's prefix.

    Beyond, both hold at most the rest of the rare shingles of the one whose prefix ends first, and all common
    shingles of the one that has fewer; where a prefix ends among rare shingles, at most the rest of that set.
    """
    an, bn, ar, br = (F.col(c) for c in ("an", "bn", "ar", "br"))
    ap = an - F.ceil(2 * percent * an / (100 + percent)) + 1
    bp = bn - F.ceil(percent * bn / 100) + 1
    beyond = F.greatest(an - ap, bn - bp)
    inside = F.least(an - ar, bn - br)
    most = F.col("met") + F.when((ap > ar) & (bp > br), inside).otherwise(beyond)
    return (100 + percent) * most >= percent * (an + bn)


def _cross_pairs(block: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (hash, cell, node, size, component, place, rare, block; by hash, cell, then size) of one hash and cell.

    They have like sizes and unlike components, and the smaller has the hash in its short prefix. A pair that
    meets at a common shingle is left out where it couldn't link without a rare one, at which it would meet too.
    """
    n = len(block)
    if n < 2:
        return
    h, comp = block[:, :2], block[:, 4]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]).any(1)))
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, n)))
    # groups within one component have nothing to add
    mixed = np.zeros(len(new), bool)
    mixed[group[1:][(group[1:] == group[:-1]) & (comp[1:] != comp[:-1])]] = True
    rows = np.flatnonzero(mixed[group])
    if not len(rows):
        return
    _, _, node, size, comp, place, rare, own = block[rows].T
    group = group[rows]
    # within a group sizes rise, so each row's partners are the rows after it up to a size bound
    scaled = group.astype(np.float64) * 2.0**32
    last = np.searchsorted(scaled + size, scaled + size * 100 // percent, "right")
    reach = np.maximum(last - np.arange(len(rows)) - 1, 0)
    at, total = 0, np.cumsum(reach)
    while at < len(rows):  # tiles of a bounded number of pairs
        end = max(at + 1, int(np.searchsorted(total, total[at] - reach[at] + 200_000, "right")))
        many = reach[at:end]
        i = np.repeat(np.arange(at, end), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        short = _prefix(size, percent, pair=True)
        # of equal sizes either may count as the smaller; the node decides, so that every hash decides alike
        turn = (size[i] == size[j]) & (node[i] > node[j])
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        is_rare = place[i] < rare[i]
        ok = (comp[i] != comp[j]) & ((own[i] != own[j]) | (own[i] < 0)) & (place[i] < short[i]) & (is_rare | (np.minimum(size[i] - rare[i], size[j] - rare[j]) >= need))
        i, j, is_rare = i[ok], j[ok], is_rare[ok]
        if len(i):
            ints = [is_rare, size[i], size[j], rare[i], rare[j]]
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), *[pa.array(x.astype(np.int32)) for x in ints]], ["a", "b", "rare", "an", "bn", "ar", "br"])
        at = end


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
