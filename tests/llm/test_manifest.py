"""The dataset manifest against one tree hashed by hand."""

import hashlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tidewater.llm import manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(leaves, fanout):
    """The root, and for each leaf its siblings left and right on each level."""
    level, at, steps = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p // fanout * fanout
            steps[i].append(("".join(level[first:p]), "".join(level[p + 1 : first + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], steps


def by_hand(rows, fanout, changed=None):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((leaf(r), r))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    built = {t: climb([x[0] for x in trees[t]], fanout) for t in order}
    root, crowns = climb([built[t][0] for t in order], fanout)
    out = []
    for t, crown in zip(order, crowns):
        subroot, steps = built[t]
        for (own, r), s in zip(trees[t], steps):
            s, node = s + crown, own
            if changed and changed(r) is not None:
                node = leaf((*r[:3], changed(r), r[4]))
            for a, b in s:
                node = h(a, node, b)
            out.append((r[0], own, subroot, root, h(*(x for step in s for x in step)), node, node == root))
    return sorted(out, key=repr)


def found(spark, rows, fanout, depth, tampered=None):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("leaf", F.lit("a clashing name")).withColumn("rank", F.lit(1))
    return sorted((tuple(r) for r in M.manifest(df, tampered, fanout, depth).collect()), key=repr)


ROWS = [(i * 3, f"s{i % 3}", ("en", "de", None, "zß", "")[0 if i % 3 else i % 5], len(f"text {i}"), f"text {i} é") for i in range(70)]
ODD = [(None, None, None, None, None), (None, None, None, None, None), (7, "a", "xx", 0, ""), (7, "a", "xx", 0, ""), (7, "b", "xx", None, "x" * 100_000), (0, None, "en", 1, None)]


@pytest.mark.parametrize("fanout, depth", [(2, 1), (2, 3), (3, 1), (2, 10)])
def test_proofs_as_by_hand(spark, fanout, depth):
    wrong = F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1)
    want = by_hand(ROWS + ODD, fanout, lambda r: r[3] + 1 if r[0] is not None and r[0] % 7 == 0 and r[3] is not None else None)
    got = found(spark, ROWS + ODD, fanout, depth, wrong)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark):
    one = [(5, "s", "en", 1, "x")]
    own = leaf(one[0])
    assert found(spark, one, 2, 2) == [(5, own, own, own, h(""), own, True)]
    assert found(spark, [], 2, 2) == []


def test_query_verifies_what_was_not_tampered_with(spark, sf_dir):
    from tidewater.llm.registry import queries

    rows = queries()["op11_dataset_manifest"](spark, sf_dir).collect()
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").collect()}
    assert len(rows) == len(docs)
    assert all(r.verified == (crc32(str(r.doc_id).encode()) % 7 != 0 or docs[r.doc_id] is None) for r in rows)
    assert len({r.root for r in rows}) == 1 and len({r.proof_sha256 for r in rows}) == len(rows)
