"""Jobs of stages: a batch that dies midway and is run again stands once, with a report."""

import json
import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewater.functions.text import content_hash
from tidewater.plans.cycle_job import EventJob
from tidewater.sources.ledgers import append_ledger
from tidewater.sources.stored import StoredTable, append_once, read_ledger
from tidewater.streaming.cycle import Cycle, Stage


def place():
    return tempfile.mkdtemp(prefix="spark-") + "/x"


def files(spark, frames):
    path = place()
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_batch_that_died_stands_once(spark):
    path, died = place(), []
    sums = StoredTable(spark, f"{path}/sums", "k long, n long", ["k"], buckets=2)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))

    def count(rows, batch):
        sums.upsert(batch, rows.groupBy((F.col("id") % 3).alias("k")).agg(F.count("*").alias("n")), add)
        return {"rows": rows.count()}

    def dies_once(rows, batch):
        append_ledger(rows.withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:00"))), f"{path}/days", batch=batch)
        append_once(rows, f"{path}/log", batch)
        if batch == 1 and not died:
            died.append(batch)
            raise RuntimeError("lost")

    def fails(rows, batch):
        raise ValueError("no")

    cycle = Cycle(spark, path, [Stage("before", fails, optional=True), Stage("count", count), Stage("log", dies_once)])
    stream = files(spark, [spark.range(10), spark.range(10, 25)])
    with pytest.raises(StreamingQueryException):
        cycle.run(stream, every=None).awaitTermination(300)
    assert {r["batch"] for r in read_ledger(spark, f"{path}/log", "id long").collect()} == {0, 1}
    cycle.run(stream, every=None).awaitTermination(300)
    assert died == [1] and sums.read().agg(F.sum("n")).first()[0] == 25
    assert read_ledger(spark, f"{path}/log", "id long").count() == 25 == spark.read.parquet(f"{path}/days").count()
    reports = {r["batch"]: json.loads(r["report"]) for r in cycle.reports().collect()}
    assert set(reports) == {0, 1} and json.loads(reports[1]["count"]["counts"]) == {"rows": 15}
    assert reports[0]["before"]["status"] == "failed: ValueError" and reports[1]["log"]["status"] == "done"


def test_event_job(spark):
    title = "Strong quake near harbour city"
    rows = [(f"https://x/{i}", "s", t, None, "natural_events", f"2024-01-01 0{i}:00:00") for i, t in enumerate([title, title + " again", "Quite another matter altogether", title])]
    df = spark.createDataFrame(rows, "link string, source_id string, title string, summary string, category string, t string")
    df = df.withColumns({"published_at": F.to_timestamp("t"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "geo_country": F.lit("PT"), "payload": F.lit("{}"), "content_hash": content_hash(F.col("title"), F.col("summary"))}).drop("t")
    rules = spark.createDataFrame([(1, 1, "quakes", "natural_events", None, None, None, None, False, True)], "user_id long, rule_id long, name string, category string, country string, min_confidence int, min_impact int, min_relevance int, only_verified boolean, enabled boolean")

    def publish(events):
        known = {c: F.lit(50) for c in ("confidence", "life_impact", "relevance")}
        return events.withColumns({**known, "verification": F.lit("VERIFIED"), "status": F.lit("PUBLISHED"), "published_at": F.col("first_seen_at")})

    path = place()
    job = EventJob(spark, path, lambda: F.to_timestamp(F.lit("2024-01-01 12:00:00")), rules, publish, buckets=2)
    stream = files(spark, [df.filter("link < 'https://x/2'"), df.filter("link >= 'https://x/1'")])
    job.cycle.run(stream, every=None).awaitTermination(600)
    assert job.articles.read().count() == 4 and job.events.members.read().count() == 4
    events = {r["title"]: r for r in job.events.events.read().collect()}
    assert set(events) == {title, "Quite another matter altogether"} and events[title]["article_count"] == 3
    told = job.told.read().collect()
    assert sorted((r["event_id"], r["batch"]) for r in told) == sorted([(events[title]["event_id"], 0), (events["Quite another matter altogether"]["event_id"], 1)])
    reports = {r["batch"]: json.loads(r["report"]) for r in job.cycle.reports().collect()}
    counts = lambda b, s: json.loads(reports[b][s]["counts"])
    assert counts(0, "ingest") == {"items": 2, "inserted": 2} and counts(1, "ingest") == {"items": 3, "inserted": 2}
    assert counts(1, "cluster") == {"duplicate": 1, "new": 1} and counts(1, "alert") == {"notified": 1}
    assert len(reports) == 2
