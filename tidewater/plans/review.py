"""Supervision, quality gate and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import published

URL = "^https?://"


def article_facts(articles: DataFrame) -> DataFrame:
    """Per event, what the checks ask of its articles."""
    return articles.groupBy("event_id").agg(
        F.count("*").alias("articles"),
        F.bool_and(F.coalesce(F.col("url").rlike(URL), F.lit(False))).alias("all_urls"),
        F.count("published_at").alias("dated"),
    )


def supervise(events: DataFrame, articles: DataFrame, conflicts: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """events with `findings` (check, ok, severity) and `decision`: BLOCK, REVIEW_REQUIRED or APPROVE.

    events: (event_id, title, category, confidence, life_impact, ...). failures: event_id of runs that failed or
    whose output was rejected; agents that aren't configured are no failures.
    """
    titled = articles.select("event_id", F.col("title").alias("_t")).join(events.select("event_id", "title"), "event_id").filter("_t = title").select("event_id").distinct().withColumn("_titled", F.lit(True))
    e = events.join(article_facts(articles), "event_id", "left").join(titled, "event_id", "left")
    for name, rows in (("_conflict", conflicts), ("_failed", failures)):
        e = e.join(rows.select("event_id").distinct().withColumn(name, F.lit(True)), "event_id", "left") if rows is not None else e.withColumn(name, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    n, conf, impact = F.coalesce("articles", F.lit(0)), F.coalesce("confidence", F.lit(0)), F.coalesce("life_impact", F.lit(0))
    checks = [
        ("has_articles", n > 0, "blocking"),
        ("urls", yes(F.col("all_urls")), "blocking"),
        ("title_traceable", yes(F.col("_titled")), "blocking"),
        ("timestamps", (n > 0) & (F.col("dated") == n), "review"),
        ("no_failures", ~yes(F.col("_failed")), "review"),
        ("confidence_known", F.col("confidence").isNotNull(), "review"),
        ("confidence_enough", conf >= 30, "review"),
        ("impact_is_backed", ~((impact >= 80) & (conf < 70)), "review"),
        ("no_conflicts", ~yes(F.col("_conflict")), "review"),
    ]
    findings = F.array(*[F.struct(F.lit(k).alias("check"), yes(c).alias("ok"), F.lit(s).alias("severity")) for k, c, s in checks])
    e = e.withColumn("findings", findings)
    fails = lambda s: F.exists("findings", lambda f: ~f["ok"] & (f["severity"] == s))
    decision = F.when(fails("blocking"), "BLOCK").when(fails("review"), "REVIEW_REQUIRED").otherwise("APPROVE")
    return e.withColumn("decision", decision).drop("_titled", "_conflict", "_failed")


def quality_gate(supervised: DataFrame, auto_publish: bool = True) -> DataFrame:
    """supervised with `gate_failures`, `publish` and the queue `priority` of what isn't published."""
    n = F.coalesce("articles", F.lit(0))
    checks = [
        ("no_article", n == 0),
        ("article_without_url", (n > 0) & ~F.coalesce("all_urls", F.lit(False))),
        ("no_timestamp", F.coalesce("dated", F.lit(0)) == 0),
        ("unclassified", F.coalesce("category", F.lit("unclassified")) == "unclassified"),
        ("confidence_unknown", F.col("confidence").isNull()),
        ("blocked", F.col("decision") == "BLOCK"),
    ]
    failures = F.filter(F.array(*[F.when(c, k) for k, c in checks]), lambda x: x.isNotNull())
    out = supervised.withColumn("gate_failures", failures)
    publish = (F.size("gate_failures") == 0) & (F.col("decision") == "APPROVE") & F.lit(auto_publish)
    out = out.withColumn("publish", publish)
    return out.withColumn("priority", F.when(~F.col("publish"), F.when(F.col("decision") == "BLOCK", 90).otherwise(50)))


def to_queue(gated: DataFrame, queue: DataFrame) -> DataFrame:
    """New work items: unpublished events without an open one."""
    open_ = queue.filter("state = 'open'").select("event_id")
    return gated.filter("not publish").join(open_, "event_id", "left_anti").select("event_id", F.array_join("gate_failures", "; ").alias("reason"), "priority", F.lit("open").alias("state"))


def review_resolution(events: DataFrame, decisions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Events after decisions (event_id, decision approve or reject, or override with `state`), and the state history.

    The first publish time is kept. Every way of deciding writes history.
    """
    d = events.join(decisions.select("event_id", "decision", F.col("state").alias("_state")), "event_id", "left")
    after = F.when(F.col("decision") == "approve", "PUBLISHED").when(F.col("decision") == "reject", "REJECTED").when(F.col("decision") == "override", F.col("_state")).otherwise(F.col("status"))
    d = d.withColumn("_after", after)
    history = d.filter(~F.col("_after").eqNullSafe(F.col("status"))).select("event_id", F.col("status").alias("from_state"), F.col("_after").alias("to_state"), as_of.alias("at"))
    out = d.withColumn("published_at", F.when(F.col("_after") == "PUBLISHED", F.coalesce("published_at", as_of)).otherwise(F.col("published_at"))).withColumn("status", F.col("_after"))
    return out.select(events.columns), history


def invariant_published_has_article(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Published events without an article with a URL; holds when empty."""
    return published(events).join(articles.filter(F.col("url").rlike(URL)).select("event_id"), "event_id", "left_anti")
