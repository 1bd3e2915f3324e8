"""Streams give what the batch forms give on the same rows."""

import tempfile
import uuid

from pyspark.sql import functions as F

from tidewater import tables as T
from tidewater.streaming import cycle, limits, views


def drained(spark, df, mode="append"):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def streamed(spark, df):
    path = tempfile.mkdtemp(prefix="spark-") + "/x"
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def dealt(spark, df, batches=10, at="at", seed=3):
    """df's rows dealt at random over so many micro-batches, and a last row so late that all others are told."""
    r = df.withColumn("_n", F.floor(F.rand(seed) * batches).cast("int")).cache()
    frames = [r.filter(F.col("_n") == n).drop("_n") for n in range(batches)]
    last = df.limit(1).withColumns({at: F.to_timestamp(F.lit("2099-01-01 00:00:00")), "id": F.lit(-1).cast(df.schema["id"].dataType)})
    return by_files(spark, [*frames, last.select(df.columns)])


def test_views_stream_in_any_order(spark, sf_dir):
    v = T.views(spark, sf_dir).filter("session < 8")
    batch = views.admit_views(v, F.col("is_bot"), minutes=5 * 1440, limit=5, hours=24)
    want = {(r["id"], r["reason"]) for r in batch.select("id", "reason").collect()}
    got = [(r["id"], r["reason"]) for r in drained(spark, views.admit_views_stream(dealt(spark, v), 5 * 1440, 5, 24, delay="60 days")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({r for _, r in want}) > 2


def test_view_that_comes_late_is_judged_by_its_time(spark):
    frame = lambda *ts: spark.createDataFrame([(1, "e", f"2024-01-01 {t}", i, False) for i, t in ts], "session int, event_id string, t string, id long, is_bot boolean").select("session", "event_id", F.to_timestamp("t").alias("at"), "id", "is_bot")
    s = by_files(spark, [frame((1, "10:50:00")), frame((2, "10:00:00"), (3, "11:10:00")), frame((4, "23:59:59"))])
    got = {r["id"]: r["reason"] for r in drained(spark, views.admit_views_stream(s, 30, delay="2 hours")).collect()}
    assert got == {2: None, 1: None, 3: "dedupe_window"}


def test_limits_streams_in_any_order(spark, sf_dir):
    e = T.read(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("ok")).filter("user_id < 8")
    s = dealt(spark, e)
    want = {r["id"] for r in limits.walk_windows(e, 5, 86_400, ["user_id"]).collect()}
    assert {r["id"] for r in drained(spark, limits.rate_limited_stream(s, 5, 86_400, "user_id", delay="60 days")).collect()} == want and want
    want = {r["id"] for r in limits.walk_lockouts(e, 3, 86_400).collect()}
    assert {r["id"] for r in drained(spark, limits.lockouts_stream(s, 3, 86_400, delay="60 days")).collect()} == want and want


def test_new_items_once(spark):
    rows = spark.createDataFrame([("https://x/1", "2024-01-01 00:00:00"), ("https://x/1", "2024-01-01 01:00:00"), ("https://x/2", "2024-01-01 00:00:00")], "link string, t string")
    s = streamed(spark, rows.select("link", F.to_timestamp("t").alias("published_at")))
    assert drained(spark, cycle.new_items(s)).count() == 2


def test_run_once(spark):
    seen = []
    s = streamed(spark, spark.range(5))
    cycle.run(s, lambda df, i: seen.append(df.count()), tempfile.mkdtemp(prefix="spark-"), every=None).awaitTermination(120)
    assert sum(seen) == 5


def test_due(spark):
    c = spark.createDataFrame([("r", "2024-01-01 00:00:00")], "job string, t string").select("job", F.to_timestamp("t").alias("last_run"))
    due = lambda job, t: cycle.due(c, job, F.to_timestamp(F.lit(t))).first()["due"]
    assert due("r", "2024-01-02 00:00:00") and not due("r", "2024-01-01 23:00:00") and due("never", "2024-01-01 00:00:00")


def by_files(spark, frames, files=1):
    """A stream of one file a frame, in order, at most so many files a micro-batch."""
    path = tempfile.mkdtemp(prefix="spark-") + "/x"
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return cycle.capped(spark, path, ", ".join(f"{c} {t}" for c, t in frames[0].dtypes), files)


def test_lockouts_outlive_a_day(spark):
    """Failures days apart count in a row, as in the batch form, and a success between them starts anew."""
    days = [0, 3, 6, 9]
    rows = [[(u, f"2024-01-{1 + day:02} 00:00:00", 10 * day + u, u == 3 and day == 3) for u in (1, 2, 3)] for day in days] + [[(1, "2024-01-10 00:05:00", 900, True), (3, "2024-01-10 00:05:00", 902, True)], [(9, "2024-02-01 00:00:00", 903, True)]]
    frames = [spark.createDataFrame(r, "user_id int, t string, id int, ok boolean").select("user_id", F.to_timestamp("t").alias("at"), "id", "ok") for r in rows]
    batch = frames[0]
    for f in frames[1:]:
        batch = batch.unionByName(f)
    want = {r["id"] for r in limits.walk_lockouts(batch, 4, 900).collect()}
    got = {r["id"] for r in drained(spark, limits.lockouts_stream(by_files(spark, frames), 4, 900)).collect()}
    assert got == want == {900}


def test_long_windows_outlive_a_day(spark):
    frames = [spark.createDataFrame([(1, f"2024-01-{d:02} 00:00:00", d)], "user_id int, t string, id int").select("user_id", F.to_timestamp("t").alias("at"), "id") for d in (1, 3, 5, 12, 20)]
    got = {r["id"] for r in drained(spark, limits.rate_limited_stream(by_files(spark, frames), 2, 7 * 86_400, "user_id")).collect()}
    assert got == {5}


def test_capped_micro_batches(spark):
    seen = []
    s = by_files(spark, [spark.range(3), spark.range(4), spark.range(5)])
    cycle.run(s, lambda df, i: seen.append(df.count()), tempfile.mkdtemp(prefix="spark-"), every=None).awaitTermination(120)
    assert sorted(seen) == [3, 4, 5]


def test_late_articles_are_left_out(spark):
    """Counts by day close behind the watermark; an article that comes 48 hours late finds its day closed."""
    frame = lambda t: spark.createDataFrame([(t,)], "t string").select(F.to_timestamp("t").alias("published_at"))
    frames = [frame(t) for t in ("2024-01-01 05:00:00", "2024-01-10 05:00:00", "2024-01-10 06:00:00", "2024-01-01 06:00:00", "2024-01-20 00:00:00", "2024-01-20 01:00:00")]
    s = cycle.late_articles(by_files(spark, frames)).groupBy(F.window("published_at", "1 day")).agg(F.count("*").alias("n"))
    got = {str(r["window"]["start"])[:10]: r["n"] for r in drained(spark, s).collect()}
    assert got["2024-01-01"] == 1 and got["2024-01-10"] == 2
    two = spark.createDataFrame([("2024-01-05 00:00:00", "2024-01-03 00:00:01"), ("2024-01-05 00:00:00", "2024-01-02 00:00:00"), ("2024-01-05 00:00:00", "2024-02-01 00:00:00")], "a string, e string")
    joins = two.select(cycle.may_join(F.to_timestamp("a"), F.to_timestamp("e")).alias("j")).collect()
    assert [r["j"] for r in joins] == [True, False, True]


def test_feed_bodies_are_read_whole(spark, tmp_path):
    from tidewater.sources import feeds

    for n in range(2):
        (tmp_path / f"f{n}.xml").write_text(f"<rss><item>\n<title>T{n}</title><link>https://n.example/{n}</link></item></rss>")
    bodies = feeds.read_feed_bodies(spark, str(tmp_path))
    assert sorted(r["title"] for r in feeds.parse_feed(bodies, F.current_timestamp()).collect()) == ["T0", "T1"]
    assert drained(spark, feeds.read_feed_bodies(spark, str(tmp_path), stream=True)).count() == 2


def test_landed_items_go_on_where_they_stopped(spark, tmp_path):
    item = "<item><title>T{0}</title><link>https://n.example/{0}</link><pubDate>Tue, 0{1} Jan 2024 10:00:00 GMT</pubDate></item>"
    landing, ledger = tmp_path / "landing", str(tmp_path / "items")
    landing.mkdir()
    for n in range(3):
        (landing / f"f{n}.xml").write_text(item.format(n, 2) + item.format(0, 2))
    take = lambda: sorted((r["title"], r["batch"]) for r in cycle.landed_items(spark, str(landing), ledger, F.to_timestamp(F.lit("2024-01-05")), files=2).collect())
    first = take()
    assert [t for t, _ in first] == ["T0", "T1", "T2"]  # the one in all three files once
    assert take() == first  # nothing new, nothing twice
    (landing / "f3.xml").write_text(item.format(3, 3) + item.format(1, 2) + "<item><title>no link</title></item>")
    again = take()
    assert [t for t, _ in again] == ["T0", "T1", "T2", "T3"] and again[:3] == first
