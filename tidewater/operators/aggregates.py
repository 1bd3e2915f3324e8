"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import hours_between
from ..functions.text import CLAIM_WORDS, entity_candidates, numeric_claim, tokens

SCORE_KINDS = ["confidence", "relevance", "life_impact", "trending", "source_reliability", "evidence_strength"]
OFFICIAL = ["official", "scientific"]


def rollup(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Per event: articles and distinct publisher groups."""
    return articles.filter("event_id is not null").join(sources, "source_id").groupBy("event_id").agg(
        F.count("*").alias("article_count"), F.count_distinct("publisher_group").alias("independent_sources")
    )


def view_counts(views: DataFrame, as_of: Column) -> DataFrame:
    counted = F.coalesce(F.col("counted"), F.lit(False))
    return views.groupBy("event_id").agg(F.count_if(counted).alias("views_total"), F.count_if(counted & (hours_between(as_of, F.col("at")) < 24)).alias("views_24h"))


def score_inputs(events: DataFrame, articles: DataFrame, sources: DataFrame, as_of: Column, conflicts: DataFrame | None = None, views: DataFrame | None = None, timeline: DataFrame | None = None) -> DataFrame:
    """What the scores are computed from: aggregates per event, made before the joins; counts without rows are 0."""
    # one row an event, source and country before anything is joined; sets are bounded by the tables of sources and countries
    n, distinct = F.col("_n"), lambda c: F.size(F.collect_set(c)).cast("long")
    a = articles.filter("event_id is not null").groupBy("event_id", "source_id", "geo_country").agg(F.count("*").alias("_n"))
    a = a.join(sources.select("source_id", "publisher_group", "origin_type", "reliability_score"), "source_id")
    facts = a.groupBy("event_id").agg(
        F.sum("_n").alias("article_count"),
        distinct("publisher_group").alias("independent_sources"),
        distinct(F.when(F.col("origin_type").isin(OFFICIAL), F.col("source_id"))).alias("official_sources"),
        F.max("reliability_score").alias("max_reliability"),
        F.try_divide(F.sum(F.col("reliability_score") * n), F.sum(F.when(F.col("reliability_score").isNotNull(), n))).cast("double").alias("avg_reliability"),
        distinct("geo_country").alias("countries"),
    )
    out = events.join(facts, "event_id", "left")
    counts = {"article_count", "independent_sources", "official_sources", "countries"}
    if conflicts is not None:
        out = out.join(conflicts.filter("not resolved").groupBy("event_id").agg(F.count("*").alias("conflicts")), "event_id", "left")
    else:
        out = out.withColumn("conflicts", F.lit(0))
    if timeline is not None:
        out = out.join(timeline.groupBy("event_id").agg(F.count("*").alias("timeline_points")), "event_id", "left")
    else:
        out = out.withColumn("timeline_points", F.col("article_count"))
    if views is not None:
        from .windows import growth

        out = out.join(growth(views, as_of), "event_id", "left")
    else:
        out = out.withColumns({"views_24h": F.lit(0), "views_prev_24h": F.lit(0)})
    counts |= {"conflicts", "timeline_points", "views_24h", "views_prev_24h"}
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in sorted(counts)})


def pivot_scores(latest_scores: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return latest_scores.groupBy("event_id").pivot("kind", kinds or SCORE_KINDS).agg(F.first("value"))


def system_counters(tables: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One row of counts, one column a name; each table is counted by itself."""
    ones = [(df if cond is None else df.filter(cond)).agg(F.count("*").alias(name)) for name, (df, cond) in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), ones)  # one row each


def country_facets(events: DataFrame, n: int = 30) -> DataFrame:
    return events.filter("status = 'PUBLISHED' and country is not null").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(n)


def articles_per_source(sources: DataFrame, articles: DataFrame) -> DataFrame:
    counts = articles.groupBy("source_id").agg(F.count("*").alias("articles"))
    return sources.select("source_id").join(counts, "source_id", "left").select("source_id", F.coalesce("articles", F.lit(0)).alias("articles"))


def rule_counts(rules: DataFrame, notifications: DataFrame) -> DataFrame:
    """Per user: rules, enabled rules, and notifications that their rules made."""
    per_user = rules.groupBy("user_id").agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled_rules"))
    made = notifications.groupBy("user_id").agg(F.count("*").alias("matches"))
    return per_user.join(made, "user_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def edge_stats(edges: DataFrame) -> DataFrame:
    """edges: one row an edge, or one row for `n` of them."""
    if "n" in edges.columns:
        mean = F.sum(F.col("strength") * F.col("n")).cast("double") / F.sum("n")
        return edges.groupBy("kind").agg(F.sum("n").alias("n"), F.floor(mean + 0.5).cast("int").alias("mean_strength"))
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.floor(F.avg("strength") + 0.5).cast("int").alias("mean_strength"))


def archive_audit(audit: DataFrame, old: Column, n: int = 20) -> DataFrame:
    """One row for all old entries: their number, first and last time, and the n most frequent actions as `action=n`."""
    entries = audit.filter(old & (F.col("action") != "audit.archived"))
    counts = entries.groupBy("action").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "action"))), 1, n)  # one entry an action
    out = counts.agg(F.sum("n").alias("entries"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), top.alias("top"))
    text = F.transform("top", lambda t: F.concat(t["action"], F.lit("="), (-t["m"]).cast("string")))
    return out.filter("entries > 0").select("entries", "first_at", "last_at", F.array_join(text, ", ").alias("actions"))


def idf_weights(titles: DataFrame, text: str = "title") -> DataFrame:
    """(token, df, idf): ln(N / df) over distinct tokens of each row."""
    n = titles.agg(F.count("*").alias("n"))
    df = titles.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))  # n is one row


def common_entities(entities: DataFrame, share: float = 0.03, floor: int = 3) -> DataFrame:
    """(name, df): case-folded names in max(floor, ceil(share of events)) events or more. entities: (event_id, name)."""
    events = entities.agg(F.count_distinct("event_id").alias("n"))
    df = entities.select("event_id", F.lower("name").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("df"))
    least = F.greatest(F.lit(floor), F.ceil(F.col("n") * share))
    return df.crossJoin(F.broadcast(events)).filter(F.col("df") >= least).select("name", "df")


def entity_mentions(articles: DataFrame) -> DataFrame:
    """(event_id, name, mentions, first): names met at least twice, or once where an event has one article."""
    text = F.concat(F.col("title"), F.lit(". "), F.coalesce("summary", F.lit("")))
    n = articles.groupBy("event_id").agg(F.count("*").alias("articles"))
    each = articles.select("event_id", "published_at", "article_id", F.posexplode(entity_candidates(text)).alias("pos", "name"))
    found = each.groupBy("event_id", "name").agg(F.count("*").alias("mentions"), F.min(F.struct("published_at", "article_id", "pos")).alias("first"))
    return found.join(n, "event_id").filter(F.col("mentions") >= F.least(F.lit(2), F.col("articles"))).drop("articles")


def source_agreement(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(event_id, groups): each publisher group with its sorted distinct source names."""
    a = articles.join(sources, "source_id").groupBy("event_id", "publisher_group").agg(F.sort_array(F.collect_set("source_name")).alias("names"))
    return a.groupBy("event_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("publisher_group", "names")))).alias("groups"))


def first_measurements(articles: DataFrame) -> DataFrame:
    """(event_id, measure, value, source_id, url): the first non-null value of each measure in article order."""
    each = articles.select("event_id", "published_at", "article_id", "source_id", "url", F.explode("measurements").alias("measure", "value")).filter("value is not null and value <> ''")
    best = each.groupBy("event_id", "measure").agg(F.min_by(F.struct("value", "source_id", "url"), F.struct("published_at", "article_id")).alias("f"))
    return best.select("event_id", "measure", "f.value", "f.source_id", "f.url")


def field_conflicts(articles: DataFrame) -> DataFrame:
    """(event_id, field, values): numbers of one kind that articles of an event state differently; all are kept."""
    text = F.concat(F.col("title"), F.lit(" "), F.coalesce("summary", F.lit("")))
    # one row an article: its fields are dealt together, once
    each = articles.select("event_id", *[numeric_claim(text, f).alias(f) for f in CLAIM_WORDS])
    sets = each.groupBy("event_id").agg(*[F.collect_set(f).alias(f) for f in CLAIM_WORDS])
    found = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in CLAIM_WORDS]), lambda c: F.size(c["values"]) > 1)
    return sets.select("event_id", F.explode(found).alias("c")).select("event_id", "c.field", F.sort_array("c.values").alias("values"))


def verification_facts(articles: DataFrame, sources: DataFrame) -> DataFrame:
    a = articles.join(sources, "source_id")
    return a.groupBy("event_id").agg(
        F.count("*").alias("articles"),
        F.count_distinct("publisher_group").alias("groups"),
        F.count_if(F.col("origin_type").isin(OFFICIAL)).alias("official"),
        F.count("published_at").alias("with_timestamp"),
        F.count("reliability_score").alias("with_reliability"),
        F.min("reliability_score").alias("min_reliability"),
        F.max("reliability_score").alias("max_reliability"),
    )


def payload_bytes(articles: DataFrame, as_of: Column) -> DataFrame:
    """Bytes of payload by age: under a week, a month, older."""
    days = hours_between(as_of, F.col("published_at")) / 24
    band = F.when(days < 7, "week").when(days < 30, "month").otherwise("older")
    return articles.groupBy(band.alias("band")).agg(F.count("*").alias("articles"), F.sum(F.octet_length("payload")).alias("bytes"))


def health_tally(health: DataFrame) -> DataFrame:
    return health.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("online", "degraded", "offline")])


def grounding_stats(claims: DataFrame) -> DataFrame:
    """Per run: proposed, kept, dropped, confidence as a rounded percentage. claims: (run_id, kept boolean)."""
    out = claims.groupBy("run_id").agg(F.count("*").alias("proposed"), F.count_if("kept").alias("kept"))
    return out.select("run_id", "proposed", "kept", (F.col("proposed") - F.col("kept")).alias("dropped"), F.floor(F.col("kept") * 100 / F.col("proposed") + 0.5).cast("int").alias("confidence"))


def has_measurement(measurements: str | Column) -> Column:
    m = F.col(measurements) if isinstance(measurements, str) else measurements
    return F.coalesce(F.exists(F.map_values(m), lambda v: v.isNotNull()), F.lit(False))
