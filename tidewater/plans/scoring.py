"""Six explainable scores per event (G4); what can't be known is null, and every value comes with its factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import age_hours, clamp_score, rounded, saturating

FORMULA_VERSION = "1"
# What a category alone is worth in life impact.
IMPACT_BASE = {
    "natural_events": 45, "war_conflict": 45, "health": 40, "energy": 30, "economy": 28, "transport": 25, "environment": 25,
    "politics": 20, "crime": 18, "finance": 15, "society": 15, "technology": 10, "ai": 10, "science": 10, "space": 8,
    "business": 10, "crypto": 8, "sports": 3, "culture": 3,
}


def _cap(col: str, most: int, each: int) -> Column:
    return F.least(F.col(col), F.lit(most)) * each


def confidence_parts() -> dict[str, Column]:
    n = F.col("article_count")
    return {
        "publisher_groups": _cap("independent_sources", 5, 12),
        "official_source": F.when(F.col("official_sources") > 0, 25).otherwise(0),
        "best_reliability": rounded(F.col("max_reliability") / 100 * 20),
        "articles": F.when(n >= 3, 10).when(n == 2, 6).otherwise(2),
        "conflicts": -F.least(F.lit(30), F.col("conflicts") * 15),
    }


def relevance_parts(as_of: Column) -> dict[str, Column]:
    age = age_hours(F.col("last_activity_at"), as_of)
    return {
        "coverage": _cap("article_count", 8, 6),
        "breadth": _cap("independent_sources", 5, 7),
        "countries": _cap("countries", 4, 4),
        "recency": F.when(age < 6, 15).when(age < 24, 10).when(age < 72, 4).otherwise(0),
        "timeline": _cap("timeline_points", 6, 2),
    }


def life_impact_parts(magnitude: Column | None = None) -> dict[str, Column]:
    base = F.create_map(*[x for k, v in IMPACT_BASE.items() for x in (F.lit(k), F.lit(v))])
    m = F.lit(None).cast("double") if magnitude is None else magnitude
    return {
        "category": F.try_element_at(base, F.col("category")),
        "magnitude": F.coalesce(rounded(F.greatest(F.lit(0.0), (m - 4) * 12)), F.lit(0)),
        "countries": _cap("countries", 4, 5),
        "breadth": _cap("independent_sources", 4, 3),
    }


def trending_parts(as_of: Column) -> dict[str, Column]:
    now, before = F.col("views_24h"), F.col("views_prev_24h")
    growth = F.when(before > 0, now / before).otherwise(2.0)
    age = age_hours(F.col("last_activity_at"), as_of)
    return {
        "views": saturating(now),
        "growth": F.least(F.lit(25), rounded((growth - 1) * 20)),
        "recency": F.when(age < 3, 15).when(age < 12, 8).otherwise(0),
    }


def evidence_parts(measured: Column | None = None) -> dict[str, Column]:
    return {
        "official_source": F.when(F.col("official_sources") > 0, 35).otherwise(0),
        "corroboration": _cap("independent_sources", 4, 10),
        "measurements": F.when(F.lit(False) if measured is None else measured, 15).otherwise(0),
        "conflicts": F.when(F.col("conflicts") > 0, -20).otherwise(0),
    }


def _sum(parts: dict[str, Column]) -> Column:
    total = F.lit(0)
    for p in parts.values():
        total = total + p
    return total


def confidence() -> Column:
    return clamp_score(_sum(confidence_parts()))


def relevance(as_of: Column) -> Column:
    return clamp_score(_sum(relevance_parts(as_of)))


def life_impact(magnitude: Column | None = None) -> Column:
    return clamp_score(_sum(life_impact_parts(magnitude)))


def trending(as_of: Column, frozen: bool = False) -> Column:
    if frozen:
        return F.lit(None).cast("int")
    return F.when(F.col("views_24h") > 0, clamp_score(_sum(trending_parts(as_of))))


def source_reliability() -> Column:
    return clamp_score(F.col("avg_reliability"))


def evidence_strength(measured: Column | None = None) -> Column:
    total = _sum(evidence_parts(measured))
    return F.when(total > 0, clamp_score(total))


def score_events(inputs: DataFrame, as_of: Column, frozen: bool = False, magnitude: Column | None = None, measured: Column | None = None) -> DataFrame:
    """Six rows per event: event_id, kind, value (null where unknown), factors (name, contribution), formula_version."""

    def row(kind: str, value: Column, parts: dict[str, Column]) -> Column:
        factors = F.array(*[F.struct(F.lit(k).alias("factor"), v.cast("string").alias("input"), v.cast("int").alias("contribution")) for k, v in parts.items()])
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), factors.alias("factors"))

    rows = F.array(
        row("confidence", confidence(), confidence_parts()),
        row("relevance", relevance(as_of), relevance_parts(as_of)),
        row("life_impact", life_impact(magnitude), life_impact_parts(magnitude)),
        row("trending", trending(as_of, frozen), trending_parts(as_of)),
        row("source_reliability", source_reliability(), {"mean_reliability": F.col("avg_reliability")}),
        row("evidence_strength", evidence_strength(measured), evidence_parts(measured)),
    )
    return inputs.select("event_id", F.explode(rows).alias("s")).select("event_id", "s.*", F.lit(FORMULA_VERSION).alias("formula_version"))
