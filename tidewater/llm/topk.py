"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to the nearest of some pivots; the vectors of a pivot are its cell, and a large cell is split into
shards of bounded size by a hash of the id. A cell's bound for a query is the product with its pivot plus the query's
length times the cell's radius, and a query is sent only to cells whose bound reaches its k-th score so far: first to
the cell of greatest bound, then, with the k-th score found there, to a quarter of the others in order of bound, then
to what is left. Every shard builds a ball tree with the same kind of bound at each node; nodes are taken by greatest
bound, and a node is left out for every query whose current k-th score exceeds the bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeing, if_small, least_hashed, prepare, saved

SHARD_ROWS, LEAF_ROWS, BLOCK = 8192, 64, 256
#: Pivots at most, bytes of all pivots at most, and rows of the sample (by least hash) that they are fitted on.
MOST_PIVOTS, PIVOT_BYTES, SAMPLE_ROWS = 1024, 8 << 20, 16_384
#: Part of a bound that covers rounding of centres and radii; scores themselves are exact integers, as all below 2^53 are in doubles.
SLACK = 1e-9


class BallTree:
    """Nodes over rows of integer vectors: centre, radius, children or rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order].astype(np.float64)
        centres, radii, self.children, self.rows = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            at = len(centres)
            part = self.x[rows]
            c = part.mean(0)
            centres.append(c)
            radii.append(float(np.sqrt(((part - c) ** 2).sum(1).max())))
            self.children.append(None)
            self.rows.append(rows)
            if len(rows) > LEAF_ROWS and radii[at] > 0:
                # along the line between two far rows: in the middle, or where that cuts off few, in halves
                one = part[((part - c) ** 2).sum(1).argmax()]
                two = part[((part - one) ** 2).sum(1).argmax()]
                along = part @ (two - one)
                low = along < (along.min() + along.max()) / 2
                if min(low.sum(), (~low).sum()) < len(rows) / 10:
                    low = np.zeros(len(rows), bool)
                    low[np.argsort(along, kind="stable")[: len(rows) // 2]] = True
                self.rows[at] = None
                self.children[at] = (grow(rows[low]), grow(rows[~low]))
            return at

        grow(np.arange(len(self.ids)))
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.longest = float(np.sqrt((self.x**2).sum(1)).max())
        #: pairs of a query and a row whose product was formed
        self.scored = 0

    def search(self, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (m x k, -inf where there are fewer) that reach `floor`, ties to smaller ids; a query's own id is left out."""
        m, q = len(q), q.astype(np.float64)
        if m and float(np.sqrt((q**2).sum(1)).max()) * self.longest >= 2**53:
            raise ValueError("vectors are too long to be scored exactly: the product of two lengths must be below 2^53")
        best = np.full((m, k), -np.inf)
        ids = np.full((m, k), np.iinfo(np.int64).max)
        kth = floor.astype(np.float64).copy()
        bound = _bounds(q, self.centres, self.radii)
        heap = [(-float(bound[:, 0].max()), 0, np.arange(m))]
        while heap:
            _, node, active = heapq.heappop(heap)
            active = active[bound[active, node] >= kth[active]]
            if not len(active):
                continue
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(heap, (-float(bound[active, c].max()), c, active))
                continue
            rows = self.rows[node]
            scores = q[active] @ self.x[rows].T
            self.scored += scores.size
            scores[self.ids[rows][None, :] == qids[active][:, None]] = -np.inf
            better = (scores >= kth[active][:, None]) & (scores > -np.inf)
            hit = better.any(1)
            active, scores, better = active[hit], scores[hit], better[hit]
            if not len(active):
                continue
            s = np.concatenate([best[active], np.where(better, scores, -np.inf)], 1)
            i = np.concatenate([ids[active], np.where(better, self.ids[rows][None, :], np.iinfo(np.int64).max)], 1)
            top = np.lexsort((i, -s), axis=1)[:, :k]
            best[active], ids[active] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            kth[active] = np.maximum(kth[active], best[active, k - 1])
        return best, ids


def _bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No inner product of a query (row of q) with what lies within `radii` of `centres` is greater."""
    long = np.sqrt((q**2).sum(1))[:, None]
    return q @ centres.T + long * radii[None, :] + SLACK * (1 + long * (np.sqrt((centres**2).sum(1)) + radii)[None, :])


FOUND = "query_id long, vec_id long, score long"


def _search(dealt: DataFrame, k: int, scored: Accumulator | None = None) -> DataFrame:
    """dealt: rows (shard, kind, id, v, floor), kind 0 a vector and 1 a query, together by shard and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        vectors: list = []
        asked: list = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, asked
            if asked and vectors:
                if tree is None:
                    tree = BallTree(np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors], np.int64))
                qids = np.array([a[0] for a in asked], np.int64)
                before = tree.scored
                best, ids = tree.search(qids, np.array([a[1] for a in asked], np.int64), np.array([a[2] for a in asked], np.float64), k)
                if scored is not None:
                    scored.add(tree.scored - before)
                ok = best > -np.inf
                if ok.any():
                    columns = [np.repeat(qids, k).reshape(-1, k)[ok], ids[ok], best[ok].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in FOUND.split(", ")])
            asked = []

        for b in batches:
            for s, kind, id_, v, floor in zip(*(b.column(i).to_pylist() for i in range(5))):
                if s != shard:
                    yield from answer()
                    shard, tree, vectors = s, None, []
                if kind == 0:
                    vectors.append((id_, v))
                else:
                    asked.append((id_, v, floor))
                    if len(asked) >= BLOCK:
                        yield from answer()
        yield from answer()

    dealt = dealt.select("shard", "kind", "id", "v", "floor").repartition("shard").sortWithinPartitions("shard", "kind", "id")
    return dealt.mapInArrow(freeing(run), FOUND)


class _Cells:
    """Pivots for each length of vector, and (once counted) the radius and the number of shards of each cell."""

    def __init__(self, vectors: DataFrame, count: int):
        hashed = vectors.select("v").withColumn("h", F.xxhash64("v"))
        sample = [np.array(r["v"], float) for r in least_hashed(saved(hashed), "h", SAMPLE_ROWS).collect()]
        self.pivots: dict[int, np.ndarray] = {}
        for size in sorted({len(x) for x in sample}):
            rows = np.array([x for x in sample if len(x) == size])
            many = min(MOST_PIVOTS, PIVOT_BYTES // (8 * size) or 1, -(-count * len(rows) // (len(sample) * SHARD_ROWS)))
            self.pivots[size] = _fitted(rows, max(1, many))
        self.radii: dict[int, np.ndarray] = {}
        self.shards: dict[int, np.ndarray] = {}

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.pivots[v.shape[1]]
        cell = ((p**2).sum(1)[None, :] - 2 * v @ p.T).argmin(1)
        return cell, np.sqrt(((v - p[cell]) ** 2).sum(1))

    def counted(self, cells: DataFrame) -> None:
        """cells: (size, cell, n, radius); one row a pivot at most, so they may come to the driver."""
        self.radii = {s: np.zeros(len(p)) for s, p in self.pivots.items()}
        self.shards = {s: np.zeros(len(p), int) for s, p in self.pivots.items()}
        for r in cells.filter("cell >= 0").collect():
            self.radii[r["size"]][r["cell"]] = r["radius"] * (1 + SLACK)
            self.shards[r["size"]][r["cell"]] = -(-r["n"] // SHARD_ROWS)


def _fitted(rows: np.ndarray, many: int, rounds: int = 6) -> np.ndarray:
    """`many` pivots at most by Lloyd's rounds; empty ones go."""
    rng = np.random.default_rng(11)
    p = rows[[int(rng.integers(len(rows)))]]
    far = ((rows - p[0]) ** 2).sum(1)
    while len(p) < many and far.max() > 0:  # far rows first, by chance
        p = np.concatenate([p, rows[[int(rng.choice(len(rows), p=far / far.sum()))]]])
        far = np.minimum(far, ((rows - p[-1]) ** 2).sum(1))
    for _ in range(rounds):
        cell = ((p**2).sum(1)[None, :] - 2 * rows @ p.T).argmin(1)
        n = np.bincount(cell, minlength=len(p))
        p = np.array([np.bincount(cell, c, len(p)) for c in rows.T]).T[n > 0] / n[n > 0][:, None]
    return p


def _in_cells(vectors: DataFrame, cells: _Cells) -> DataFrame:
    """(size, cell, radius, id, v): each vector's cell and its distance from the pivot; cell -1 for lengths without pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(2))
            cell, far = np.full(len(size), -1), np.zeros(len(size))
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                if s in cells.pivots:
                    cell[at], far[at] = cells.nearest(np.array(b.column(1).take(pa.array(at)).to_pylist(), float))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(cell, pa.int32()), pa.array(far), b.column(0), b.column(1)], ["size", "cell", "radius", "id", "v"])

    return vectors.select("id", "v", F.size("v").alias("size")).mapInArrow(freeing(run), "size int, cell int, radius double, id long, v array<long>")


def _sent(asked: DataFrame, cells: _Cells, wave: int) -> DataFrame:
    """Queries (id, v, floor) with the shards that they visit in a wave: (shard, kind, id, v, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vs, floors = (b.column(i).to_pylist() for i in range(3))
            rows, shards = [], []
            for i, (v, floor) in enumerate(zip(vs, floors)):
                if len(v) not in cells.pivots:
                    if wave == 0:
                        rows.append(i)
                        shards.append(f"{len(v)}/-1/0")
                    continue
                many = cells.shards[len(v)]
                bound = _bounds(np.array([v], float), cells.pivots[len(v)], cells.radii[len(v)])[0]
                order = np.lexsort((np.arange(len(bound)), -bound))
                order = order[many[order] > 0]
                cut = [0, 1, 1 + -(-(len(order) - 1) // 4), len(order)]
                for c in order[cut[wave] : cut[wave + 1]].tolist():
                    if bound[c] >= floor:
                        rows += [i] * int(many[c])
                        shards += [f"{len(v)}/{c}/{p}" for p in range(many[c])]
            if rows:
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(np.ones(len(rows), np.int32)), *part.columns], ["shard", "kind", "id", "v", "floor"])

    return asked.select("id", "v", "floor").mapInArrow(freeing(run), "shard string, kind int, id long, v array<long>, floor double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scored: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best vectors by integer inner product, ties to smaller vec_id.

    Both inputs: (id, v array of long). Null or empty vectors and null ids take no part, nor do vectors of another
    length than the query's. Rows with the query's id aren't its candidates; repeated ids and vectors are
    candidates of their own, and a repeated query id counts once. Fewer candidates than k give as many rows; no
    rows give none. What no bound leaves out is scored exactly; the job fails where two lengths multiply to 2^53 or more. `scored`, if given, counts the pairs that are
    scored; where vectors lie in no clusters, bounds leave out little and that is all pairs.
    """
    spark = vectors.sparkSession
    prepare(spark)
    ok = "id is not null and v is not null and size(v) > 0"
    vectors = saved(vectors.filter(ok).select("id", "v"))
    cells = _Cells(vectors, vectors.count())
    dealt = saved(_in_cells(vectors, cells))
    cells.counted(dealt.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")))
    parts = spark.createDataFrame([(s, c, int(n)) for s, many in cells.shards.items() for c, n in enumerate(many)] or [(0, 0, 1)], "size int, cell int, parts int")
    # vectors of one length form cells of their own, so that products are always defined
    base = dealt.join(F.broadcast(parts), ["size", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    base = base.select(F.concat_ws("/", "size", "cell", "part").alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(float("-inf")).alias("floor"))
    asked = saved(queries.filter(ok).groupBy("id").agg(F.min("v").alias("v")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = None
    for wave in range(3):
        if found is None:
            waiting = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            # a k-th score is known where k were found
            kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s")).filter(F.col("n") >= k)
            waiting = asked.join(kth, asked["id"] == kth["query_id"], "left").select("id", "v", F.coalesce("s", F.lit(float("-inf"))).alias("floor"))
        sent = saved(_sent(waiting, cells, wave))
        if found is not None and sent.isEmpty():
            continue
        # shards that no query visits aren't dealt
        visited = base.join(if_small(saved(sent.select("shard").distinct())), "shard", "left_semi")
        more = _search(visited.unionByName(sent), k, scored)
        every = more if found is None else found.drop("rank").unionByName(more)
        found = saved(every.withColumn("rank", rank).filter(F.col("rank") <= k))
    return found.select("query_id", "rank", "vec_id", "score")


def quantised(rows: DataFrame) -> DataFrame:
    """(id, v): floor(256 * x) of each component, as double; vectors with null or non-finite components go."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v")
    )


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(rows, rows.filter("id % 50 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
