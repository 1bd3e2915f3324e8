"""Stored postings: questions read their terms' buckets only; batches add up."""

import tempfile

from pyspark.sql import functions as F

from tidewater.operators.rows import search_ranked, search_substring
from tidewater.plans.postings import Postings


def test_questions_read_their_buckets_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.timestamp_micros(F.col("doc_id") * 1_000_000).alias("at"), F.substring("text", 1, 40).alias("title"))
    p = Postings(spark, tempfile.mkdtemp(prefix="spark-") + "/p", buckets=32)
    p.add(0, docs.filter("doc_id < 120"), ("title",))
    p.add(1, docs.filter("doc_id >= 120"), ("title",))
    p.add(1, docs, ("title",))
    asked = ["heed Erst", "que", "of the", "nothingofthekind", "tion"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, q string")
    found = p.ranked(q)
    got = sorted((r["query_id"], r["doc_id"], r["tf"], r["rank"]) for r in found.collect())
    want = [(i, r["doc_id"], r["tf"], r["rank"]) for i, text in enumerate(asked) for r in search_ranked(docs, text).collect()]
    assert got == sorted(want) and want
    plan = p.words.lookup_by(spark.createDataFrame([("heed",), ("erst",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan
    hits = {i: [r["doc_id"] for r in search_substring(docs.withColumnsRenamed({"doc_id": "event_id", "at": "last_activity_at"}), text, fields=("title",)).select(F.col("event_id").alias("doc_id")).collect()] for i, text in enumerate(asked)}
    told = {}
    for r in p.containing(q).collect():
        told.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert {i: set(v) for i, v in hits.items() if v} == told and told


def test_an_index_holds_one_row_a_document_and_bucket(spark):
    """What is stored grows with the texts: no value beside each of its runs, no row for each word, no words where none are asked for."""
    title = "a long title of many words, which has some hundred runs of two and three characters"
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.timestamp_micros(F.col("id")).alias("at"), F.lit(title).alias("title"))
    p = Postings(spark, tempfile.mkdtemp(prefix="spark-") + "/p", buckets=4)
    p.add(0, docs.unionByName(docs), ("title",))
    assert p.grams.read().count() <= 80 and "value" not in p.grams.read().columns and p.words.read().count() == 0
    p.add(1, docs.withColumn("text", F.concat(F.col("title"), F.lit(" Words words"))))
    assert p.words.read().count() <= 80
    q = spark.createDataFrame([(1, "words"), (2, "w")], "query_id int, q string")
    assert {(r["doc_id"], r["tf"], r["rank"]) for r in p.ranked(q).collect()} == {(i, 3, 707106) for i in range(20)}
    assert {r["doc_id"] for r in p.containing(q).collect()} == set(range(20))
