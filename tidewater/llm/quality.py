"""Quality classification by hierarchical empirical Bayes.

A logistic model over text statistics gives each document's evidence. Soft counts of that evidence, grouped by
host and by path within host, give each site a posterior rate of good documents: a path's rate is shrunk toward
its host's, a host's toward the global rate, each by a Beta prior whose weight comes from the spread of rates
among groups. A document's odds are its evidence with the training prior replaced by its path's posterior,
counted without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, freeing, if_small, least_hashed, prepare, saved, word_hashes, words

#: At most so many labelled rows train the model: those whose hashed doc_id is least.
TRAINING_ROWS = 20_000
FEATURES = ("lower", "upper", "digit", "space", "line", "stop", "shout", "bar", "symbol", "other", "wide", "log_bytes", "word_bytes", "fresh", "run")

_CLASS = np.full(256, 9, np.int64)  # other ASCII
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "#$%&*@~^=+<>/\\_"]] = 8
_CLASS[128:] = 10


def _features(texts: pa.Array) -> np.ndarray:
    """Shares of byte classes, length, mean word length, share of distinct words, share of words like the one before."""
    out = []
    for first, last, data, offsets in chunks(texts):
        n, sizes = last - first, np.diff(offsets)
        row = np.repeat(np.arange(n), sizes)
        shares = np.bincount(row * 11 + _CLASS[data], minlength=n * 11).reshape(n, 11) / np.maximum(sizes, 1)[:, None]
        starts, ends, at = words(data, offsets)
        h, count = word_hashes(data, starts, ends), np.diff(at)
        of = np.repeat(np.arange(n), count)
        size = np.bincount(of, ends - starts, n) / np.maximum(count, 1)
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        fresh = np.bincount(of[order], new, n) / np.maximum(count, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        run = np.bincount(of, same, n) / np.maximum(count, 1)
        out.append(np.column_stack([shares, np.log1p(sizes), size, fresh, run]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method on standardised features: mean, scale, weights (bias last)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict:
    """The document model from at most `rows` labelled documents; those chosen don't depend on partitioning.

    Rows with null doc_id or quality don't train; with labels of fewer than two classes every document is kept.
    """
    prepare(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = least_hashed(saved(chosen.withColumn("_h", F.xxhash64("doc_id"))), "_h", rows).drop("_h")
    rows_ = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = rows_.mapInArrow(freeing(run), "y double, x array<double>").toPandas()
    y = got["y"].to_numpy(float) if len(got) else np.zeros(0)
    if len(set(y)) < 2:
        return {"mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "weights": np.append(np.zeros(len(FEATURES)), 4.0), "prior": 0.9820138}
    mean, scale, w = _fit(np.array(got["x"].tolist()), y)
    return {"mean": mean, "scale": scale, "weights": w, "prior": float(y.mean())}


def evidence(docs: DataFrame, model: dict, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence): the document model's log odds, one row per input row. Null texts are empty."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.clip((_features(b.column(3)) - model["mean"]) / model["scale"], -8, 8)
            odds = z @ model["weights"][:-1] + model["weights"][-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(odds, pa.float64())], ["doc_id", "host", "path", "evidence"])

    return rows.mapInArrow(freeing(run), "doc_id long, host string, path string, evidence double")


def posteriors(found: DataFrame, prior: float) -> DataFrame:
    """Adds the posterior rates of each row's host and path, without the row itself, and the combined probability.

    Sums are combined before the shuffle, so a host with a third of all rows costs no more than another. Null
    hosts and paths are groups of their own.
    """
    spark = found.sparkSession
    p = 1 / (1 + F.exp(-F.col("evidence")))
    found = found.withColumn("_p", p)
    host = F.coalesce("host", F.lit(""))
    path = F.coalesce("path", F.lit(""))
    key = found.withColumns({"_host": F.when(F.col("host").isNull(), "null").otherwise(F.concat(F.lit("="), host)), "_path": F.when(F.col("path").isNull(), "null").otherwise(F.concat(F.lit("="), path))})
    paths = saved(key.groupBy("_host", "_path").agg(F.sum("_p").alias("path_good"), F.count("*").alias("path_n")))
    hosts = paths.groupBy("_host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"), F.count("*").alias("host_paths"))
    whole = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n"), F.count("*").alias("groups")).first()
    rate = min(max(whole["good"] / whole["n"], 1e-6), 1 - 1e-6) if whole["n"] else prior

    def weight(groups: DataFrame, good: str, n: str, around: Column) -> float:
        """The Beta prior's weight by moments: how much the groups' rates spread beyond what their sizes explain."""
        m = groups.agg(
            F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - around, 2)).alias("s"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * F.col(n)).alias("n2")
        ).first()
        if not m["k"] or m["k"] < 2 or not m["n"]:
            return 10.0
        noise = rate * (1 - rate)
        spread = (m["s"] - (m["k"] - 1) * noise) / max(m["n"] - m["n2"] / m["n"], 1e-9)
        return float(min(max(noise / spread - 1, 1.0), 1e4)) if spread > 0 else 1e4

    host_weight = weight(hosts, "host_good", "host_n", F.lit(rate))
    hosts = if_small(saved(hosts))
    joined = if_small(saved(paths.join(hosts, "_host")))  # so that a large side can be split in the join
    path_weight = weight(joined, "path_good", "path_n", F.col("host_good") / F.col("host_n"))
    key = key.join(joined, ["_host", "_path"], "left")
    host_rate = (F.col("host_good") - F.col("_p") + host_weight * rate) / (F.col("host_n") - 1 + host_weight)
    path_rate = (F.col("path_good") - F.col("_p") + path_weight * F.col("host_posterior")) / (F.col("path_n") - 1 + path_weight)
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    key = key.withColumn("host_posterior", clip(host_rate)).withColumn("path_posterior", clip(path_rate))
    odds = F.col("evidence") - float(np.log(prior / (1 - prior))) + F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    return key.withColumn("quality", 1 / (1 + F.exp(-odds))).select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality")


def score_documents(docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, host, path, evidence, host_posterior, path_posterior, quality, keep.

    documents has no URL, so by default column source stands for the host and lang for the path; the second level
    is then source x language. A table with URLs gives its own host and path as columns.

    Null and empty texts are scored like other texts (they have no words). Repeated rows and null doc_ids are
    rows of their own; extra columns are left out; no rows give no rows.
    """
    host = F.col(host) if isinstance(host, str) else host
    path = F.col(path) if isinstance(path, str) else path
    model = train(docs, labels)
    found = saved(evidence(docs, model, host, path))
    return posteriors(found, min(max(model["prior"], 1e-6), 1 - 1e-6)).withColumn("keep", F.col("quality") >= threshold)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
