"""Stored tables: only touched buckets are rewritten, and a batch that is run again changes nothing."""

import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.plans import graph
from tidewater.sources import feeds, ledgers
from tidewater.sources.stored import StoredTable, append_once, read_ledger


def place():
    return tempfile.mkdtemp(prefix="spark-") + "/t"


def files(path):
    """Files of rows by bucket, each with its time and inode."""
    found = {}
    for p in Path(path, "rows").glob("_bucket=*/*.parquet"):
        s = os.stat(p)
        found.setdefault(p.parent.name.split("=")[1], set()).add((p.name, s.st_mtime_ns, s.st_ino))
    return found


def test_an_upsert_of_few_keys_rewrites_their_buckets_only(spark):
    path = place()
    t = StoredTable(spark, path, "source_id long, name string", ["source_id"], buckets=50)
    assert t.read().count() == 0
    all_ = spark.range(1000).select(F.col("id").alias("source_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"))
    assert len(t.upsert(0, all_)) == 50
    before = files(path)
    new = spark.range(995, 1005).select(F.col("id").alias("source_id"), F.lit("new").alias("name"))
    touched = t.upsert(1, new)
    after = files(path)
    assert {b for b in after if after[b] != before.get(b)} == set(touched) and len(touched) <= 10
    rows = {r[0]: r[1] for r in t.read().collect()}
    assert len(rows) == 1005 and rows[3] == "s3" and rows[994] == "s994" and rows[995] == rows[1004] == "new"
    # the same batch again, and readers of some keys
    assert t.upsert(1, all_) == [] and files(path) == after
    assert sorted(tuple(r) for r in t.lookup(spark.createDataFrame([(3,), (1004,), (5000,)], "source_id long")).collect()) == [(3, "s3"), (1004, "new")]
    with pytest.raises(ValueError):
        StoredTable(spark, path, "source_id long, name string", ["source_id"], buckets=51)


def test_a_batch_that_died_is_finished(spark, monkeypatch):
    path = place()
    t = StoredTable(spark, path, "id long, n long", ["id"], buckets=8)
    t.upsert(0, spark.range(100).select("id", F.lit(0).cast("long").alias("n")))
    add = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))
    rows = spark.range(10).select("id", F.lit(1).cast("long").alias("n"))

    def dies(*_):
        raise RuntimeError("lost")

    # after staging, before anything is marked as done: a sum that ran twice would count twice
    with monkeypatch.context() as m:
        m.setattr("tidewater.sources.stored.remove", dies)
        with pytest.raises(RuntimeError):
            t.upsert(1, rows, add)
    again = StoredTable(spark, path, "id long, n long", ["id"], buckets=8)
    again.upsert(1, rows, add)
    assert again.read().agg(F.sum("n"), F.count("*")).first()[:] == (10, 100)
    # before the staged buckets are in place
    with monkeypatch.context() as m:
        m.setattr(type(t), "_with_bucket", dies)
        with pytest.raises(RuntimeError):
            t.upsert(2, rows, add)
    again.upsert(2, rows, add)
    again.upsert(2, rows, add)
    assert again.read().agg(F.sum("n")).first()[0] == 20


def test_pure_upserts_over_stored_tables(spark):
    t = StoredTable(spark, place(), "source_id int, name string, note string", ["source_id"], buckets=4)
    row = lambda *r: spark.createDataFrame([r], t.schema)
    t.upsert(0, row(1, "a", "x"), feeds.upsert_sources)
    t.upsert(1, row(1, "b", None), feeds.upsert_sources)
    assert [tuple(r) for r in t.read().collect()] == [(1, "b", None)]
    articles = StoredTable(spark, place(), "link string, published_at timestamp, article_id string", ["article_id"], buckets=4)
    items = spark.createDataFrame([("https://x/1", "2024-01-01 00:00:00"), ("https://x/2", "2024-01-02 00:00:00")], "link string, t string").select("link", F.to_timestamp("t").alias("published_at"))
    for batch in (0, 1):
        new = feeds.insert_new_articles(items, articles.read())
        assert new.count() == (2 if batch == 0 else 0)
        articles.upsert(batch, new)
    assert articles.read().count() == 2
    edges = StoredTable(spark, place(), "from_id long, to_id long, kind string, strength long, basis string", ["from_id", "to_id", "kind"], buckets=4)
    for batch, strength in enumerate((40, 70)):
        edges.upsert(batch, spark.createDataFrame([(1, 2, "k", strength, "b")], edges.schema), graph.upsert_edges)
    assert [tuple(r) for r in edges.read().collect()] == [(1, 2, "k", 70, "b")]
    found = spark.createDataFrame([(7, "depth", ["1", "2"])], "event_id long, field string, values array<string>")
    conflicts = StoredTable(spark, place(), "conflict_id string, event_id long, field string, detail string, resolved boolean", ["conflict_id"], buckets=4)
    for batch in (0, 1):
        conflicts.upsert(batch, ledgers.upsert_conflicts(spark.createDataFrame([], conflicts.schema), found))
    assert conflicts.read().count() == 1


def test_ledgers_append_a_batch_once(spark):
    path = place()
    assert read_ledger(spark, path, "id long").count() == 0
    for _ in range(2):
        append_once(spark.range(3), path, 0)
    append_once(spark.range(2), path, 1)
    assert sorted(tuple(r) for r in read_ledger(spark, path, "id long").groupBy("batch").count().collect()) == [(0, 3), (1, 2)]


def test_retention_drops_days_and_rewrites_the_mixed_one(spark):
    """Thirty days of runs; the newest run of an event stays however old it is."""
    from datetime import datetime

    from tidewater.operators.windows import latest
    from tidewater.plans.retention import expire

    path = place()
    t = StoredTable(spark, path, "run_id long, event_id long, at timestamp", ["run_id", "at"], by="date(at)")
    rows = spark.range(720).select(F.col("id").alias("run_id"), F.when(F.col("id") == 50, 99).otherwise(F.col("id") % 3).cast("long").alias("event_id"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id))").alias("at"))
    t.upsert(0, rows)
    before = files(path)
    assert len(before) == 30
    # a dry look: nothing is old enough
    assert expire(t, 1, "at", datetime(2023, 1, 1)) == {"dropped": [], "rewritten": []} and files(path) == before
    cutoff = datetime(2024, 1, 11, 6)
    newest = lambda table: latest(table, ["event_id"], "at", "run_id")
    done = expire(t, 2, "at", cutoff, newest)
    after = files(path)
    days = [f"2024-01-{d:02}" for d in range(1, 31)]
    assert done == {"dropped": [d for d in days[:10] if d != "2024-01-03"], "rewritten": ["2024-01-03", "2024-01-11"]}
    assert sorted(after) == ["2024-01-03", *days[10:]]
    assert {d for d in after if after[d] != before[d]} == {"2024-01-03", "2024-01-11"}
    want = {r["run_id"] for r in rows.filter(F.col("at") >= F.lit(cutoff)).collect()} | {50}
    assert {r["run_id"] for r in t.read().collect()} == want
    expire(t, 2, "at", cutoff, newest)
    assert files(path) == after


def test_an_annotator_fails_on_one_event_of_a_thousand(spark):
    from tidewater.plans.annotators import Annotator, failures, run_annotators

    def step(row):
        if row["event_id"] == 7:
            raise ValueError("no")
        return {"status": "ok", "output": "{}", "confidence": 1000 // (row["n"] or 1)} if row["event_id"] != 8 else {"status": "ok", "confidence": "much"}

    events = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("n"))
    runs = run_annotators(events, [Annotator("a", "1", F.lit(True), each=step), Annotator("b", "1", F.col("n") == 0)], F.current_timestamp()).cache()
    got = {tuple(r) for r in runs.groupBy("agent", "status", "reason").count().collect()}
    assert got == {("a", "ok", None, 998), ("a", "unavailable", "error", 2), ("b", "unavailable", "not_configured", 200)}
    assert {r["event_id"] for r in failures(runs).collect()} == {7, 8}
