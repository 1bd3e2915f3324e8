"""Predicates and projections over events, articles and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import age_hours, freshness, hours_between
from ..functions.text import label_of, tokens, url_host
from ..saved import if_small, saved
from .dictionary import contained_in

# Category keys and their labels.
CATEGORY_LABELS = {
    "general_news": "General news", "natural_events": "Natural events", "conspiracy_claims": "Claims", "politics": "Politics",
    "war_conflict": "War and conflict", "economy": "Economy", "finance": "Finance", "crypto": "Crypto", "technology": "Technology",
    "ai": "Artificial intelligence", "science": "Science", "space": "Space", "health": "Health", "environment": "Environment",
    "energy": "Energy", "business": "Business", "society": "Society", "crime": "Crime", "transport": "Transport", "sports": "Sports",
    "culture": "Culture", "unclassified": "Unclassified",
}
PLACEHOLDER_HOSTS = r"(^|\.)(example\.(com|org|net)|localhost|test|invalid)$"


def published(events: DataFrame) -> DataFrame:
    test = F.coalesce(F.col("is_test"), F.lit(False)) if "is_test" in events.columns else F.lit(False)
    return events.filter((F.col("status") == "PUBLISHED") & ~test)


def score_at_least(col: str | Column, least: int | Column) -> Column:
    """An unknown score never passes, whatever the threshold (which is not negative)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit(-1)) >= least


def in_list(col: str, values: list) -> Column:
    return F.col(col).isin(values)


def list_events(events: DataFrame, as_of: Column, category: str | None = None, country: str | None = None, since_hours: float | None = None, min_confidence: int | None = None, min_impact: int | None = None) -> DataFrame:
    """Published events under the conditions that are given."""
    out = published(events)
    if category:
        out = out.filter(F.col("category") == category)
    if country:
        out = out.filter(F.col("country") == country.upper())
    if since_hours is not None:
        out = out.filter(hours_between(as_of, F.col("last_activity_at")) < since_hours)
    if min_confidence is not None:
        out = out.filter(score_at_least("confidence", min_confidence))
    if min_impact is not None:
        out = out.filter(score_at_least("life_impact", min_impact))
    return out


def map_points(events: DataFrame, most: int | None = 300) -> DataFrame:
    out = published(events).filter("lat is not null and lon is not null")
    return out if most is None else out.orderBy(F.desc_nulls_last("last_activity_at"), "event_id").limit(most)


def decorate(events: DataFrame, as_of: Column) -> DataFrame:
    return events.withColumns(
        {
            "label": label_of(CATEGORY_LABELS, F.col("category")),
            "freshness": freshness(F.col("category"), F.col("last_activity_at"), as_of),
            "age_hours": F.round(age_hours(F.col("last_activity_at"), as_of), 2),
            "url": F.concat(F.lit("/event/"), F.col("event_id").cast("string")),
        }
    )


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled and not blocked")


def search_substring(events: DataFrame, q: str, articles: DataFrame | None = None, fields: tuple[str, ...] = ("title", "place"), most: int = 40) -> DataFrame:
    """Events with `q` (two characters at least) in a field or in a linked article's title, newest first."""
    needle = q.strip().lower()
    if len(needle) < 2:
        return events.limit(0)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(F.col(f).cast("string")).contains(needle), F.lit(False))
    found = events.filter(hit)
    if articles is not None:
        linked = articles.filter(F.lower("title").contains(needle)).select("event_id")
        found = found.unionByName(events.filter(~hit).join(linked, "event_id", "left_semi"))
    return found.orderBy(F.desc_nulls_last("last_activity_at"), "event_id").limit(most)


def facets_from_text(queries: DataFrame, categories: DataFrame, countries: DataFrame) -> DataFrame:
    """(query_id, query) with min_impact, since_hours, category, country and what text is left.

    categories: (key, label, ordinal); countries: (name, country, ordinal). The first by ordinal wins; impact and
    today phrases leave the text, a category's or country's name stays.
    """
    impact, today = r"(?i)impact\s*(?:>=?|≥|above|over)?\s*([0-9]{1,3})", r"(?i)\b(today|hoje)\b"
    q = queries.withColumns(
        {
            "min_impact": F.nullif(F.regexp_extract("query", impact, 1), F.lit("")).cast("int"),
            "since_hours": F.when(F.col("query").rlike(today), 24),
            "rest": F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("query", impact, " "), today, " "), r"\s+", " ")),
        }
    )
    texts = q.select(F.col("query_id").alias("id"), F.concat(F.lit(" "), F.lower("query"), F.lit(" ")).alias("text"))

    # both dictionaries in one pass; the first row, by ordinal, one of whose names a query has
    kinds = {"category": (categories, ["label", "key"], "key"), "country": (countries, ["name"], "country")}
    each = [t.select(F.lit(k).alias("kind"), F.explode(F.array(*[F.lower(n) for n in names])).alias("name"), F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.col(v).alias("value")).alias("first")) for k, (t, names, v) in kinds.items()]
    rows = saved(each[0].unionByName(each[1]))
    found = contained_in(texts, rows.select(F.col("name").alias("name_id"), "name").distinct())
    met = found.join(if_small(rows), F.col("name_id") == F.col("name"))
    best = met.groupBy(F.col("id").alias("query_id")).agg(*[F.min(F.when(F.col("kind") == k, F.col("first")))["value"].alias(k) for k in kinds])
    return q.join(best, "query_id", "left")


def search_ranked(docs: DataFrame, q: str, id_col: str = "doc_id", text_col: str = "text", at: str | None = None, most: int = 40) -> DataFrame:
    """Documents that hold every term of `q`, by a count rank: summed term frequency over the square root of length.

    The rank is this engine's own; cover density isn't imitated. Ties go to the later time, then the id.
    """
    from ..functions.text import fold_text

    # the question's terms are few; each is counted in the row's own words, which are folded once
    wanted = [r["term"] for r in docs.sparkSession.range(1).select(F.explode(tokens(F.lit(q))).alias("term")).collect()]
    if not wanted:
        return docs.select(id_col, F.lit(0).alias("tf"), F.lit(0).cast("long").alias("rank")).limit(0)
    words = F.filter(F.split(fold_text(F.col(text_col)), " "), lambda w: w != "")
    rows = docs.select(id_col, *([at] if at else []), words.alias("_words"))

    def times(term: str) -> Column:
        return F.size(F.filter("_words", lambda w: w == term))

    counts = [times(t) for t in wanted]
    hits = rows.withColumn("_n", F.array(*counts)).withColumn("length", F.size("_words")).drop("_words").filter(F.forall("_n", lambda n: n > 0))
    out = hits.withColumn("tf", F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n)).drop("_n")
    out = out.withColumn("rank", F.floor(F.col("tf") * 1_000_000 / F.sqrt("length")).cast("long"))
    return out.orderBy(F.desc("rank"), *([F.desc_nulls_last(at)] if at else []), id_col).limit(most)


def pending_articles(articles: DataFrame, most: int = 500) -> DataFrame:
    test = F.coalesce(F.col("is_test"), F.lit(False)) if "is_test" in articles.columns else F.lit(False)
    return articles.filter(F.col("event_id").isNull() & ~test).orderBy(F.coalesce("published_at", "ingested_at").asc_nulls_last(), "article_id").limit(most)


def suspect_rows(rows: DataFrame, url: str = "url", samples: int = 5) -> DataFrame:
    """Counts and samples of flagged rows and of rows whose host is a placeholder; the path of a URL doesn't count."""
    host = F.lower(url_host(F.col(url)))
    why = F.when(F.coalesce(F.col("is_test"), F.lit(False)), "flagged") if "is_test" in rows.columns else F.when(F.lit(False), "flagged")
    why = why.when(host.rlike(PLACEHOLDER_HOSTS), "placeholder_host")
    found = rows.select(why.alias("reason"), F.col(url).alias("sample")).filter("reason is not null")
    counts = found.groupBy("reason").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    first = found.withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy("sample"))).filter(F.col("_r") <= samples)
    return counts.join(first.groupBy("reason").agg(F.sort_array(F.collect_list("sample")).alias("samples")), "reason")


ARCHIVED = '{"archived":true}'


def unarchived_payloads(articles: DataFrame, marker: str = ARCHIVED) -> DataFrame:
    return articles.filter(~F.col("payload").eqNullSafe(F.lit(marker)))


def explode_factors(scores: DataFrame) -> DataFrame:
    return scores.select("event_id", "kind", F.explode("factors").alias("f")).select("event_id", "kind", "f.factor", "f.input", "f.contribution")


def explode_measurements(rows: DataFrame, col: str = "measurements") -> DataFrame:
    return rows.select("event_id", F.explode(col).alias("measure", "value")).filter("value is not null")


def explode_findings(reviews: DataFrame) -> DataFrame:
    return reviews.select("event_id", F.explode("findings").alias("f")).select("event_id", "f.*")
