"""Clustering onto stored events: each batch of articles joins events that are there and founds new ones.

The store has events, their members, what identifies them (content hashes, providers' ids) and an index of meeting
words by window of time, so that a batch reads the windows that its articles can reach and no more. A batch's
decisions are written first, and all tables are updated from them, each once for a batch number: a batch that dies
is run again and changes what it hadn't changed yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import event_id, slugify
from ..operators.joins import content_dups, provider_matches
from ..saved import if_small, saved
from ..sources.stored import StoredTable, append_once, exists, read_ledger
from ..streaming.cycle import may_join, run
from .cluster import THRESHOLD, WINDOW_HOURS, describe, founders, meeting_words, meetings, scored, similar_pairs, token_counts, window_of

_PROVIDER = "$.measurements.provider_event_id"
EVENTS = (
    "founder_id string, event_id string, slug string, title string, summary string, category string, status string, country string, lat double, lon double, payload string, "
    "founded_at timestamp, first_seen_at timestamp, last_activity_at timestamp, article_count long, independent_sources long"
)
MEMBERS = "founder_id string, event_id string, article_id string, source_id string, publisher_group string, title string, published_at timestamp, how string, score double"
DECISIONS = MEMBERS.replace("event_id string, ", "") + ", summary string, category string, geo_country string, lat double, lon double, payload string, content_hash string, at timestamp"
TIMELINE = "event_id string, at timestamp, label string, article_id string, source_id string"
STATES = "event_id string, from_state string, to_state string, reason string, actor string"
PROVENANCE = "object_type string, object_id string, field string, value string, source_id string, article_id string, derivation string"


class EventStore:
    """Tables of events under one path. Articles' ids and sources are kept as strings."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD, hours: float = WINDOW_HOURS, reach: str = "founded_at", buckets: int = 64):
        """reach: the time from which an event stays open for `hours`; `founded_at` as in one batch, or `last_activity_at`, which later articles extend."""
        if reach not in ("founded_at", "last_activity_at"):
            raise ValueError("an event is open from founded_at or last_activity_at")
        self.spark, self.path, self.threshold, self.hours, self.reach = spark, path.rstrip("/"), threshold, hours, reach
        table = lambda name, schema, keys, by=None: StoredTable(spark, f"{self.path}/{name}", schema, keys, buckets, by)
        self.events = table("events", EVENTS, ["founder_id"])
        # an event's members lie in its bucket
        self.members = table("members", MEMBERS, ["founder_id", "article_id"], f"pmod(xxhash64(founder_id), {buckets})")
        self.hashes = table("hashes", "content_hash string, founder_id string", ["content_hash"])
        self.providers = table("providers", "source_id string, provider string, founder_id string", ["source_id", "provider"])
        self.index = table("index", "founder_id string, published_at timestamp, category string, reach double, role string, token string, place int, n int, own int, other int, w long", ["w", "role", "token", "other", "founder_id"], "w")

    def timeline(self) -> DataFrame:
        return read_ledger(self.spark, f"{self.path}/timeline", TIMELINE)

    def states(self) -> DataFrame:
        return read_ledger(self.spark, f"{self.path}/states", STATES)

    def provenance(self) -> DataFrame:
        return read_ledger(self.spark, f"{self.path}/provenance", PROVENANCE)

    def add(self, batch: int, articles: DataFrame, as_of: Column, groups: DataFrame | None = None) -> DataFrame:
        """Clusters a batch of articles into the store; (article_id, event_id, how) of its articles.

        articles: as for cluster(); those without a publish time count as of as_of. groups: (source_id,
        publisher_group); a source without one is a group of its own. An id that the store has is left alone.
        """
        decided = f"{self.path}/decisions/batch={batch}"
        if not exists(self.spark, f"{decided}/_SUCCESS"):
            append_once(self._decide(articles, as_of, groups), f"{self.path}/decisions", batch)
        rows = self.spark.read.schema(DECISIONS).parquet(decided)
        new = rows.filter("how = 'new'")
        # ids come from the founders, old or new
        ids = saved(self.events.lookup(rows.select("founder_id")).select("founder_id", "event_id").unionByName(new.select("founder_id", self._event_id().alias("event_id"))).dropDuplicates(["founder_id"]))
        members = rows.join(ids, "founder_id")
        self.members.upsert(batch, members)
        self._update_events(batch, members, as_of)
        self.hashes.upsert(batch, rows.filter("content_hash is not null").groupBy("content_hash").agg(F.min_by("founder_id", F.struct("at", "article_id")).alias("founder_id")), lambda old, n: old.unionByName(n.join(old, "content_hash", "left_anti")))
        named = rows.withColumn("provider", F.get_json_object("payload", _PROVIDER)).filter("provider is not null").groupBy("source_id", "provider").agg(F.min_by("founder_id", F.struct("at", "article_id")).alias("founder_id"))
        self.providers.upsert(batch, named, lambda old, n: old.unionByName(n.join(old, ["source_id", "provider"], "left_anti")))
        self._index(batch, new)
        stamped = members.withColumn("when", F.coalesce("published_at", "at"))
        append_once(stamped.select("event_id", F.col("when").alias("at"), F.col("title").alias("label"), "article_id", "source_id"), f"{self.path}/timeline", batch)
        fresh = members.filter("how = 'new'")
        append_once(fresh.select("event_id", F.lit("EVENT_DETECTED").alias("from_state"), F.lit("CLUSTERED").alias("to_state"), F.concat(F.lit("new event from article "), "article_id").alias("reason"), F.lit("cluster").alias("actor")), f"{self.path}/states", batch)
        said = F.when(F.col("how") == "new", F.col("title")).when(F.col("how") == "similar", F.concat(F.lit("similarity "), F.format_number("score", 2))).otherwise(F.col("how"))
        append_once(
            members.select(F.lit("event").alias("object_type"), F.col("event_id").alias("object_id"), F.when(F.col("how") == "new", "title").otherwise("clustered_article").alias("field"), said.alias("value"), "source_id", "article_id", F.when(F.col("how") == "new", "verbatim").otherwise("computed").alias("derivation")),
            f"{self.path}/provenance", batch,
        )
        return members.select("article_id", "event_id", "how")

    @staticmethod
    def _event_id() -> Column:
        return event_id(F.concat(F.col("content_hash"), F.lit("|"), F.coalesce("source_id", F.lit(""))), F.col("at"))

    def _decide(self, articles: DataFrame, as_of: Column, groups: DataFrame | None) -> DataFrame:
        """Each new article with the founder of its event, how it got there, and what the tables need of it."""
        a = articles.withColumns({"article_id": F.col("article_id").cast("string"), "source_id": F.col("source_id").cast("string"), "at": F.coalesce("published_at", as_of), "category": F.coalesce("category", F.lit("unclassified"))})
        # an id that is in the ledger of decisions has its event
        known = read_ledger(self.spark, f"{self.path}/decisions", DECISIONS).select("article_id")
        a = saved(a.dropDuplicates(["article_id"]).join(known, "article_id", "left_anti"))
        timed = a.withColumn("published_at", F.col("at"))
        # the same content or provider's id, in the store or earlier in the batch
        hashes, providers = self.hashes.lookup(a.filter("content_hash is not null").select("content_hash")), self.providers.lookup(self._named(a))
        by_hash = saved(a.join(hashes, "content_hash").select("article_id", "founder_id", F.lit("duplicate").alias("how"), F.lit(None).cast("double").alias("score")))
        rest = timed.join(by_hash.select("article_id"), "article_id", "left_anti")
        dups = saved(content_dups(rest))
        rest = rest.join(dups.select("article_id"), "article_id", "left_anti")
        by_provider = saved(rest.withColumn("provider", F.get_json_object("payload", _PROVIDER)).join(providers, ["source_id", "provider"]).select("article_id", "founder_id", F.lit("provider").alias("how"), F.lit(None).cast("double").alias("score")))
        rest = rest.join(by_provider.select("article_id"), "article_id", "left_anti")
        followers = saved(provider_matches(rest))
        left = saved(rest.join(followers.select("article_id"), "article_id", "left_anti"))
        own = saved(similar_pairs(left, self.threshold, self.hours))
        stored = saved(self._stored_pairs(left))
        # what joins a stored event founds none
        free = left.select(F.col("article_id").alias("id")).join(stored.select(F.col("later").alias("id")).distinct(), "id", "left_anti")
        free = saved(free)
        among = own.join(free.withColumnRenamed("id", "later"), "later", "left_semi").join(free.withColumnRenamed("id", "earlier"), "earlier", "left_semi")
        heads = saved(founders(free, among))
        to_heads = own.join(heads.select(F.col("id").alias("earlier")), "earlier", "left_semi").join(heads.select(F.col("id").alias("later")), "later", "left_anti")
        choice = to_heads.select("later", "earlier", "score", "earlier_at").unionByName(stored)
        best = choice.groupBy("later").agg(F.max_by(F.struct("earlier", "score"), F.struct("score", "earlier_at", "earlier")).alias("b"))
        direct = heads.select(F.col("id").alias("article_id"), F.col("id").alias("founder_id"), F.lit("new").alias("how"), F.lit(None).cast("double").alias("score"))
        direct = direct.unionByName(best.select(F.col("later").alias("article_id"), F.col("b.earlier").alias("founder_id"), F.lit("similar").alias("how"), F.col("b.score").alias("score")))
        direct = saved(direct.unionByName(by_provider))
        follow = lambda rows, where, how: rows.join(where.select(F.col("article_id").alias("first_article_id"), "founder_id"), "first_article_id").select("article_id", "founder_id", F.lit(how).alias("how"), F.lit(None).cast("double").alias("score"))
        placed = saved(direct.unionByName(follow(followers, direct, "provider")))
        placed = placed.unionByName(follow(dups, placed, "duplicate")).unionByName(by_hash)
        if groups is not None:
            a = a.join(groups.select(F.col("source_id").cast("string").alias("source_id"), F.col("publisher_group").cast("string").alias("_group")), "source_id", "left")
        group = F.coalesce("_group", F.concat(F.lit("source "), F.col("source_id"))) if groups is not None else F.concat(F.lit("source "), F.col("source_id"))
        return placed.join(a.withColumn("publisher_group", group), "article_id").select([f.strip().split(" ")[0] for f in DECISIONS.split(",")])

    def _named(self, articles: DataFrame) -> DataFrame:
        return articles.select("source_id", F.get_json_object("payload", _PROVIDER).alias("provider")).filter("provider is not null")

    def _counts(self) -> DataFrame | None:
        """The order of words that the index was founded with; None before."""
        path = f"{self.path}/order"
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else None

    def _stored_pairs(self, left: DataFrame) -> DataFrame:
        """(later, earlier, score, earlier_at): articles with the founders of stored events that they may join.

        An event must have been open after the article's time less `hours`, however much newer it is: an article that
        comes late looks in every window from the one before its own to the newest.
        """
        counts = self._counts()
        nothing = self.spark.createDataFrame([], "later string, earlier string, score double, earlier_at timestamp")
        span = left.agg(F.min(window_of(F.col("published_at"), self.hours))).first()[0]
        if counts is None or span is None:
            return nothing
        # windows are by founding; an event that has been active since may have been founded in any of them before
        first = span - 1 if self.reach == "founded_at" else None
        index = self.index.read(None if first is None else lambda b: b.cast("long") >= first)
        newest = index.agg(F.max("w")).first()[0]
        if newest is None:
            return nothing
        rows = saved(describe(left))
        w = window_of(F.col("published_at"), self.hours)
        words = meeting_words(rows, counts, self.threshold)
        from_ = w - 1 if first is not None else F.lit(index.agg(F.min("w")).first()[0])
        words = words.withColumn("w", F.explode(F.when(from_ <= newest, F.sequence(from_.cast("long"), F.lit(newest).cast("long")))))
        near = may_join(F.col("a_published_at"), F.col("b_published_at"), self.hours) if first is not None else F.lit(True)
        pairs = saved(meetings(saved(words), index.withColumnRenamed("founder_id", "id"), self.threshold, near))
        events = saved(self.events.lookup(pairs.select(F.col("b_id").alias("founder_id"))))
        open_from = F.col(self.reach)
        heads = describe(events.select(F.col("founder_id").alias("article_id"), F.col("founded_at").alias("published_at"), "category", "title", "summary", "lat", "lon", F.col("country").alias("geo_country"), "payload"))
        heads = heads.join(events.select(F.col("founder_id").alias("id"), open_from.alias("open_from")), "id")
        alike = scored(pairs, rows, heads, self.threshold)
        alike = alike.filter(may_join(F.col("a_published_at"), F.col("b_open_from"), self.hours))
        return alike.select(F.col("a_id").alias("later"), F.col("b_id").alias("earlier"), "score", F.col("b_published_at").alias("earlier_at"))

    def _update_events(self, batch: int, members: DataFrame, as_of: Column) -> None:
        """Rows of new events, and activity and counts of those that got members; counts come from all members."""
        touched = saved(members.groupBy("founder_id").agg(F.max("at").alias("latest")))
        counts = self.members.lookup_by(touched.select("founder_id")).groupBy("founder_id").agg(F.count("*").alias("article_count"), F.count_distinct("publisher_group").alias("independent_sources"))
        seen = F.least(F.col("at"), as_of)
        fresh = members.filter("how = 'new'").select(
            "founder_id", "event_id", slugify(F.col("title")).alias("slug"), "title", "summary", "category", F.lit("CLUSTERED").alias("status"), F.col("geo_country").alias("country"), "lat", "lon", "payload",
            F.col("at").alias("founded_at"), seen.alias("first_seen_at"), seen.alias("last_activity_at"),
        )
        old = self.events.lookup(touched.select("founder_id")).drop("article_count", "independent_sources")
        rows = old.join(fresh.select("founder_id"), "founder_id", "left_anti").unionByName(fresh).join(touched, "founder_id").join(counts, "founder_id")
        self.events.upsert(batch, rows.withColumn("last_activity_at", F.greatest("last_activity_at", F.least("latest", as_of))))

    def _index(self, batch: int, new: DataFrame) -> None:
        """Adds new founders' titles under the windows in which they were founded."""
        rows = saved(describe(new.withColumn("published_at", F.col("at"))))
        if self._counts() is None:
            token_counts(rows).write.mode("overwrite").parquet(f"{self.path}/order")
        words = meeting_words(rows.withColumn("body_tokens", F.array().cast("array<string>")), self._counts(), self.threshold)
        words = words.withColumnRenamed("id", "founder_id").withColumn("w", window_of(F.col("published_at"), self.hours))
        self.index.upsert(batch, words, lambda old, n: old.unionByName(n))


def cluster_stream(stream: DataFrame, store: EventStore, checkpoint: str, as_of: Column, groups: DataFrame | None = None, every: str | None = "10 minutes") -> StreamingQuery:
    """Clusters a stream of articles into a store, a micro-batch at a time; what Spark runs again changes nothing twice.

    There is no watermark: however late an article is, it may join an event that was active after its time less the window.
    """
    return run(stream, lambda rows, batch: store.add(batch, rows, as_of, groups), checkpoint, every)
