"""Retention (G15): what goes, what stays, counted first; writes only when it isn't a dry run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import hours_between
from ..operators.aggregates import archive_audit
from ..operators.joins import unreferenced
from ..operators.rows import ARCHIVED, unarchived_payloads
from ..operators.windows import newest_overall, protect_latest
from ..saved import saved
from ..sources.stored import StoredTable


@dataclass(frozen=True)
class Policy:
    """Days, and a number of payloads; given values must be finite and not negative."""

    payload_days: float = 14
    run_days: float = 30
    audit_days: float = 90
    view_days: float = 60
    stale_event_days: float = 45
    edge_days: float = 30
    review_days: float = 30
    payloads: int = 2000

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if not (isinstance(v, (int, float)) and v == v and 0 <= v < float("inf")):
                raise ValueError(f"{f.name} must be finite and not negative: {v!r}")

    def with_(self, **given) -> Policy:
        return Policy(**(asdict(self) | given))


def older(at: str, days: float, as_of: Column) -> Column:
    return F.coalesce(hours_between(as_of, F.col(at)) > days * 24, F.lit(False))


def blank_payloads(articles: DataFrame, policy: Policy, as_of: Column) -> DataFrame:
    """articles with `blank`: attached payloads past the age, and of the rest those beyond the newest N; each counts once."""
    live = unarchived_payloads(articles)
    aged = F.col("event_id").isNotNull() & older("published_at", policy.payload_days, as_of)
    young = newest_overall(live.filter(~aged), policy.payloads, "published_at", "article_id").filter("not keep").select("article_id")
    blank = live.filter(aged).select("article_id").unionByName(young).withColumn("blank", F.lit(True))
    return articles.join(blank, "article_id", "left").withColumn("blank", F.coalesce("blank", F.lit(False)))


def stale_events(events: DataFrame, policy: Policy, as_of: Column, open_reviews: DataFrame, follows: DataFrame, bookmarks: DataFrame) -> DataFrame:
    old = events.filter(older("last_activity_at", policy.stale_event_days, as_of) & (F.col("status") != "PUBLISHED"))
    return unreferenced(old, "event_id", open_reviews.select("event_id"), follows.select("event_id"), bookmarks.select("event_id"))


def stale_edges(edges: DataFrame, events: DataFrame, policy: Policy, as_of: Column) -> DataFrame:
    """Old edges with neither end published."""
    live = events.filter("status = 'PUBLISHED'").select("event_id")
    old = edges.filter(older("created_at", policy.edge_days, as_of))
    return old.join(live.withColumnRenamed("event_id", "from_id"), "from_id", "left_anti").join(live.withColumnRenamed("event_id", "to_id"), "to_id", "left_anti")


def retain(tables: dict[str, DataFrame], as_of: Column, policy: Policy = Policy(), dry_run: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A report (step, rows) and, unless it is a dry run, the tables as they are afterwards.

    tables: article, run, audit, view, event, edge, review, queue, follow, bookmark.
    """
    t = tables
    articles = blank_payloads(t["article"], policy, as_of)
    runs = protect_latest(t["run"], ["event_id", "agent"], "at", "run_id", older("at", policy.run_days, as_of))
    old_audit = older("at", policy.audit_days, as_of)
    audit = t["audit"].filter(old_audit & (F.col("action") != "audit.archived"))
    views = t["view"].filter(older("at", policy.view_days, as_of))
    follows = t["follow"].filter("kind = 'event'").select(F.col("target").cast(t["event"].schema["event_id"].dataType).alias("event_id"))
    events = stale_events(t["event"], policy, as_of, t["queue"].filter("state = 'open'"), follows, t["bookmark"])
    edges = stale_edges(t["edge"], t["event"], policy, as_of)
    reviews = protect_latest(t["review"], ["event_id"], "reviewed_at", "review_id", older("reviewed_at", policy.review_days, as_of))
    gone = {"payloads": articles.filter("blank"), "runs": runs, "audit": audit, "views": views, "events": events, "edges": edges, "reviews": reviews}
    from ..operators.joins import concat

    report = concat([df.agg(F.lit(k).alias("step"), F.count("*").alias("rows")) for k, df in gone.items()])
    if dry_run:
        return report, {}
    summary = archive_audit(t["audit"], old_audit)
    ids = events.select("event_id")
    detached = articles.join(ids.withColumn("_gone", F.lit(True)), "event_id", "left")
    after = {
        "article": detached.withColumn("payload", F.when(F.col("blank"), ARCHIVED).otherwise(F.col("payload"))).withColumn("event_id", F.when(F.col("_gone").isNull(), F.col("event_id"))).select(t["article"].columns),
        "run": t["run"].join(runs.select("run_id"), "run_id", "left_anti"),
        "audit": t["audit"].filter(~(old_audit & (F.col("action") != "audit.archived"))).unionByName(summary.select(F.lit("audit.archived").alias("action"), as_of.alias("at"), F.col("actions").alias("detail")), allowMissingColumns=True),
        "view": t["view"].filter(~older("at", policy.view_days, as_of)),
        "event": t["event"].join(ids, "event_id", "left_anti"),
        "edge": t["edge"].join(edges.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti"),
        "review": t["review"].join(reviews.select("review_id"), "review_id", "left_anti"),
    }
    return report, after


def expire(table: StoredTable, batch: int, at: str, cutoff: datetime, protect: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, list[str]]:
    """Takes rows with `at` before the cutoff (UTC) out of a table whose buckets are the days of `at`.

    Days that end before the cutoff are dropped by name, the day that holds it is rewritten, and later ones aren't
    touched. protect(rows of the table) gives rows that stay however old they are (all columns): the old days that
    hold any are rewritten with these alone. Returns what was dropped and what was rewritten.
    """
    day = cutoff.date().isoformat()
    old = [n for n in table.bucket_names() if n < day]
    kept = None if protect is None else saved(protect(table.read()).filter(F.col(at) < F.lit(cutoff)).select(table.schema.names))
    held = set() if kept is None else {r[0] for r in kept.select(table.bucket().alias("b")).distinct().collect()}  # at most one a day
    mixed = [n for n in table.bucket_names() if n == day or (n < day and n in held)]

    def left(rows: DataFrame) -> DataFrame:
        young = rows.filter(F.col(at) >= F.lit(cutoff))
        return young if kept is None else young.unionByName(kept)

    dropped = sorted(set(old) - held)
    table.rewrite(batch, mixed, left, dropped)
    return {"dropped": dropped, "rewritten": sorted(mixed)}
