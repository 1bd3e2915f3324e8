"""The whole cycle as one restartable job: new articles, events, relations, alerts, each stored once for a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..saved import saved
from ..sources.feeds import insert_new_articles
from ..sources.stored import StoredTable
from ..streaming.cycle import Cycle, Stage, notify
from .event_store import EventStore
from .graph import BAND_HOURS, relate, upsert_edges
from .products import match_alerts

ARTICLES = (
    "article_id string, link string, source_id string, title string, summary string, category string, published_at timestamp, lat double, lon double, geo_country string, payload string, content_hash string, batch long"
)
EDGES = "from_id string, to_id string, kind string, strength long, basis string"
TOLD = "user_id long, rule_id long, event_id string, reason string, batch long"
Review = Callable[[DataFrame], DataFrame]


def no_review(events: DataFrame) -> DataFrame:
    """Events as they are: unknown scores, nothing verified, nothing published."""
    unknown = {c: F.lit(None).cast("int") for c in ("confidence", "life_impact", "relevance")}
    return events.withColumns({**unknown, "verification": F.lit(None).cast("string"), "published_at": F.col("first_seen_at")})


class EventJob:
    """Stages ingest, cluster, relate and alert over a stream of items; `before` may be run first and fail (retention)."""

    def __init__(self, spark: SparkSession, path: str, as_of: Callable[[], Column], rules: DataFrame | None = None, review: Review = no_review, groups: DataFrame | None = None, before: Callable[[DataFrame, int], dict[str, int] | None] | None = None, buckets: int = 64):
        """review adds scores, verification and published_at to events and may publish them; as_of is asked in each batch."""
        self.spark, self.as_of, self.rules, self.review, self.groups = spark, as_of, rules, review, groups
        self.articles = StoredTable(spark, f"{path}/articles", ARTICLES, ["article_id"], buckets)
        self.events = EventStore(spark, f"{path}/store", buckets=buckets)
        self.edges = StoredTable(spark, f"{path}/edges", EDGES, ["from_id", "to_id", "kind"], buckets)
        self.told = StoredTable(spark, f"{path}/told", TOLD, ["user_id", "rule_id", "event_id"], buckets)
        stages = [Stage("ingest", self._ingest), Stage("cluster", self._cluster), Stage("relate", self._relate), Stage("alert", self._alert)]
        self.cycle = Cycle(spark, path, ([Stage("before", before, optional=True)] if before else []) + stages)

    def _ingest(self, items: DataFrame, batch: int) -> dict[str, int]:
        """Items (link, source_id, title, ...) by the ids of their links; those that the table has are left alone."""
        known = self.articles.read().filter(F.col("batch") != batch)
        new = saved(insert_new_articles(items, known).withColumn("batch", F.lit(batch).cast("long")).select(self.articles.schema.names))
        self.articles.upsert(batch, new)
        return {"items": items.count(), "inserted": new.count()}

    def _cluster(self, items: DataFrame, batch: int) -> dict[str, int]:
        placed = saved(self.events.add(batch, self.articles.read().filter(F.col("batch") == batch), self.as_of(), self.groups))
        return {r["how"]: r["n"] for r in placed.groupBy("how").agg(F.count("*").alias("n")).collect()}  # four ways at most

    def _relate(self, items: DataFrame, batch: int) -> dict[str, int]:
        """Edges of events active about the time of what this batch touched; older ones have theirs."""
        events = self.events.events.read()
        touched = self.events.timeline().filter(F.col("batch") == batch).select("event_id").distinct()
        since = saved(events.join(touched, "event_id").agg(F.min("last_activity_at").alias("least")))
        near = events.crossJoin(F.broadcast(since)).filter(F.col("last_activity_at") >= F.col("least") - F.expr(f"interval {BAND_HOURS} hours"))  # one row
        near = near.select(F.col("event_id").alias("id"), "title", "category", "country", F.lit(None).cast("string").alias("place"), "lat", "lon", F.when(F.col("lat").isNotNull(), "exact").when(F.col("country").isNotNull(), "approximate").alias("geo_precision"), "last_activity_at")
        edges = saved(relate(saved(near)).select(self.edges.schema.names))
        self.edges.upsert(batch, edges, upsert_edges)
        return {"edges": edges.count()}

    def _alert(self, items: DataFrame, batch: int) -> dict[str, int]:
        if self.rules is None:
            return {}
        events = self.review(self.events.events.read())
        told = self.told.read().filter(F.col("batch") != batch)
        matches = match_alerts(self.rules, events, told, self.as_of())
        return {"notified": notify(saved(matches), self.told, batch).count()}
