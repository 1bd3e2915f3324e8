"""Clustering onto stored events: batches give what one batch gives, late articles, rows of events."""

import random
import tempfile
from datetime import datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.plans import cluster
from tidewater.plans.event_store import EventStore, cluster_stream

ARTICLE = "article_id string, source_id string, title string, summary string, category string, published_at timestamp, lat double, lon double, geo_country string, payload string, content_hash string"


def as_of():
    return F.to_timestamp(F.lit("2024-03-01 00:00:00"))


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def place():
    return tempfile.mkdtemp(prefix="spark-") + "/store"


def made(n, seed, words=30):
    """Articles of few words, some of them common, with places, providers, repeats and rows without a category."""
    rng = random.Random(seed)
    vocabulary = [f"{'strong' if i % 5 == 0 else 'w'}{i:02d}x" for i in range(words)]
    rows, titles = [], []
    for i in range(n):
        title = rng.choice(titles) if titles and rng.random() < 0.15 else " ".join(rng.sample(vocabulary[:3], 2) + rng.sample(vocabulary, rng.randint(2, 5)))
        titles.append(title)
        located = rng.random() < 0.3
        payload = '{"measurements":{"provider_event_id":"p%d"}}' % rng.randrange(4) if rng.random() < 0.25 else "{}"
        rows.append(
            (
                f"a{i:04d}", f"s{i % 4}", title, rng.choice([None, " ".join(rng.sample(vocabulary, 6))]), rng.choice(["x", "x", "y", "unclassified"]), at(i * 2 + rng.random()),
                rng.uniform(0, 3) if located else None, rng.uniform(0, 3) if located else None, rng.choice([None, "PT", "ES"]), payload, None,
            )
        )
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, ARTICLE)
    return df.withColumn("content_hash", X.content_hash(F.col("title"), F.col("summary")))


def test_pairs_by_rarest_words_are_all_pairs(spark):
    a = frame(spark, made(120, 3))
    rows = cluster.describe(a).cache()
    side = lambda s: rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns])
    both = side("a").crossJoin(side("b")).filter("struct(b_published_at, b_id) < struct(a_published_at, a_id) and unix_micros(a_published_at) - unix_micros(b_published_at) < 48 * 3600000000L")
    both = both.filter("a_category = b_category or a_category = 'unclassified'").filter(~cluster.blocked()).withColumn("score", cluster.similarity()).filter("score >= 0.3")
    want = {(r["a_id"], r["b_id"], round(r["score"], 9)) for r in both.collect()}
    got = [(r["later"], r["earlier"], round(r["score"], 9)) for r in cluster.similar_pairs(a).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_common_words_form_few_pairs(spark):
    """Titles of two words that all have and four of their own: meeting by any word forms all pairs, by the rarest few."""
    rows = [(f"a{i:04d}", "s", f"common usual {' '.join(f'own{i // 2:04d}n{k}' for k in range(4))}", None, "x", at(i / 100), None, None, None, "{}", f"h{i}") for i in range(400)]
    described = cluster.describe(spark.createDataFrame(rows, ARTICLE)).cache()
    words = cluster.meeting_words(described, cluster.token_counts(described)).withColumn("w", F.lit(0)).cache()
    order = F.struct("b_published_at", "b_id") < F.struct("a_published_at", "a_id")
    formed = cluster.meetings(words, words, cluster.THRESHOLD, order).count()
    assert formed == 200 and formed * 10 < 400 * 399 / 2


def founded(spark, store):
    """article -> (founder, how), over the store's members."""
    return {r["article_id"]: (r["founder_id"], r["how"]) for r in store.members.read().collect()}


def test_batches_give_what_one_gives(spark, monkeypatch):
    """A stream of three batches, of which the last dies midway and is run again."""
    rows = made(60, 7)
    one, many = EventStore(spark, place(), buckets=2), EventStore(spark, place(), buckets=2)
    one.add(0, frame(spark, rows), as_of())
    path, checkpoint = place(), tempfile.mkdtemp(prefix="spark-")
    for part in (rows[:20], rows[20:35], rows[35:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(path)
    index = EventStore._index

    def dies_once(self, batch, new):
        if batch == 2 and not seen:
            seen.append(batch)
            raise RuntimeError("lost")
        index(self, batch, new)

    seen = []
    monkeypatch.setattr(EventStore, "_index", dies_once)
    for _ in range(2):
        try:
            cluster_stream(stream, many, checkpoint, as_of(), every=None).awaitTermination(600)
        except StreamingQueryException:
            pass
    assert seen == [2]
    whole = {r["article_id"]: r["event_article_id"] for r in cluster.cluster(frame(spark, rows)).collect()}
    got = founded(spark, many)
    assert {k: v[0] for k, v in got.items()} == whole
    assert founded(spark, one) == got and {how for _, how in got.values()} == {"new", "similar", "duplicate", "provider"}
    for name in ("events", "members", "hashes", "providers"):
        assert sorted(map(repr, getattr(one, name).read().collect())) == sorted(map(repr, getattr(many, name).read().collect())), name
    # articles again in another batch
    many.add(3, frame(spark, rows[:10]), as_of())
    assert founded(spark, many) == got and many.timeline().count() == many.provenance().count() == 60 and many.states().count() == many.events.read().count()


def test_rows_of_events(spark):
    t = "Strong quake near harbour city"
    rows = [
        ("a1", "s1", t, "one", "n", at(0), None, None, "PT", "{}", None),
        ("a2", "s2", t, "two", "n", at(5), None, None, "PT", "{}", None),
        ("a3", "s3", t, "three", "n", at(7), None, None, "PT", "{}", None),
        ("a4", "s1", "Quite another matter altogether", None, None, None, None, None, None, "{}", None),
    ]
    groups = spark.createDataFrame([("s1", "g"), ("s2", "g")], "source_id string, publisher_group string")
    store = EventStore(spark, place(), buckets=2)
    store.add(0, frame(spark, rows[:1]), as_of(), groups)
    assert [(r["article_count"], r["last_activity_at"]) for r in store.events.read().collect()] == [(1, at(0))]
    store.add(1, frame(spark, rows[1:]), as_of(), groups)
    found = {r["founder_id"]: r for r in store.events.read().collect()}
    e = found["a1"]
    assert set(found) == {"a1", "a4"} and e["event_id"].startswith("EVT-2024-01-01-") and e["slug"] == "strong-quake-near-harbour-city"
    assert (e["article_count"], e["independent_sources"], e["first_seen_at"], e["last_activity_at"], e["status"]) == (3, 2, at(0), at(7), "CLUSTERED")
    assert found["a4"]["category"] == "unclassified" and found["a4"]["founded_at"] == datetime(2024, 3, 1)


def test_late_articles_join_newer_events(spark):
    t = "Strong quake near harbour city"
    row = lambda i, hours: (i, "s", t, i, "n", at(hours), None, None, "PT", "{}", None)
    store = EventStore(spark, place(), buckets=2)
    store.add(0, frame(spark, [row("new", 1000)]), as_of())
    store.add(1, frame(spark, [row("late", 10), row("after", 1100)]), as_of())
    got = founded(spark, store)
    # five weeks late it still joins; what comes more than 48 hours after an event's founding doesn't
    assert got == {"new": ("new", "new"), "late": ("new", "similar"), "after": ("after", "new")}
    open_ = EventStore(spark, place(), buckets=2, reach="last_activity_at")
    for batch, hours in enumerate((0, 40, 80)):
        open_.add(batch, frame(spark, [row(f"a{batch}", hours)]), as_of())
    assert {k: v[0] for k, v in founded(spark, open_).items()} == {"a0": "a0", "a1": "a0", "a2": "a0"}
