"""Row enrichment: classification, geocoding, entities, conflicts, verification, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_text, is_attributed, term_match, title_case
from ..operators.aggregates import OFFICIAL, entity_mentions, field_conflicts, first_measurements, verification_facts
from ..operators.dictionary import contained_in, named_in
from ..operators.windows import top_n, winner
from ..saved import if_small, saved

#: Windows of passages, and ids of cited articles, are sent to every task up to so many; beyond, they join by shuffle.
BROADCAST_WINDOWS = 1_000_000


def classify(articles: DataFrame, rules: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(article_id, category, score, runner_up, confidence).

    rules: (category, term, weight, ordinal); each term that occurs as a word adds its weight. declared: (source_id,
    category) of sources with exactly one category, worth 2. The highest sum wins, the smaller ordinal on ties,
    and rules come before declared categories; without any the category is `unclassified`.
    Terms meet texts by their words (named_in), however many they are.
    """
    text = F.lower(F.concat_ws(" ", F.lit(""), F.col("title"), F.col("summary"), F.lit("")))
    rules = saved(rules.withColumn("term", F.lower(F.trim("term"))).filter("term <> ''").select("category", "term", "weight", "ordinal"))
    # words as the boundary rule sees them: runs of letters and digits, à to ÿ among them
    texts, names = articles.select(F.col("article_id").alias("id"), text.alias("text")), rules.select(F.col("term").alias("name_id"), F.col("term").alias("name")).distinct()
    # an accented letter at a term's edge asks for no boundary there, so such terms may stand inside a word
    inside = F.col("name").rlike("^[à-ÿ]|[à-ÿ]$")
    found = named_in(texts, names.filter(~inside), "a-zà-ÿ0-9", term_match).unionByName(contained_in(texts, names.filter(inside), term_match))
    hits = found.join(if_small(rules), F.col("name_id") == F.col("term")).select(F.col("id").alias("article_id"), "category", "weight", "ordinal")
    if declared is not None:
        own = articles.join(declared, "source_id").select("article_id", declared["category"], F.lit(2).alias("weight"), F.lit(1_000_000).alias("ordinal"))
        hits = hits.unionByName(own)
    sums = hits.groupBy("article_id", "category").agg(F.sum("weight").alias("score"), F.min("ordinal").alias("ordinal"))
    best = winner(sums, "article_id", "category", "score", "ordinal")
    best = articles.select("article_id").join(best, "article_id", "left")
    score, second = F.coalesce("score", F.lit(0)), F.coalesce("runner_up", F.lit(0))
    return best.select(
        "article_id",
        F.coalesce("category", F.lit("unclassified")).alias("category"),
        score.cast("long").alias("score"),
        second.cast("long").alias("runner_up"),
        F.when((score >= 6) & (score > second), "high").when(score >= 3, "medium").otherwise("low").alias("confidence"),
    )


def geocode(articles: DataFrame, gazetteer: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(article_id, country, place, lat, lon, precision): the first place by ordinal, cities before countries.

    gazetteer: (name, country, lat, lon, kind, ordinal), of any size: places meet texts by their words (named_in).
    Without a place a two-letter source country stands, without coordinates; a place found is always approximate.
    """
    text = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", "title", "summary")), F.lit(" "))
    quote = lambda name: F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    named = lambda text, name: F.regexp_like(text, F.concat(F.lit("(^|[^a-zà-ÿ])"), quote(name), F.lit("([^a-zà-ÿ]|$)")))
    places = saved(gazetteer.select("name", "country", "lat", "lon", "kind", "ordinal"))
    first = F.struct((F.col("kind") != "city").cast("int").alias("k"), F.col("ordinal"))
    names = places.select(F.col("name").alias("name_id"), "name").distinct()
    found = named_in(articles.select(F.col("article_id").alias("id"), text.alias("text")), names, "a-zà-ÿ", named)
    hits = found.join(if_small(places), F.col("name_id") == F.col("name"))
    best = hits.groupBy("id").agg(F.min_by(F.struct("name", "country", "lat", "lon"), first).alias("g")).withColumnRenamed("id", "article_id")
    out = articles.join(best, "article_id", "left")
    own = F.lit(None).cast("string")
    if sources is not None:
        out = out.join(sources.select("source_id", F.col("country").alias("_own")), "source_id", "left")
        own = F.when(F.length("_own") == 2, F.col("_own"))
    return out.select(
        "article_id",
        F.coalesce("g.country", own).alias("country"),
        title_case(F.col("g.name")).alias("place"),
        F.col("g.lat").alias("lat"),
        F.col("g.lon").alias("lon"),
        F.when(F.col("g").isNotNull(), "approximate").otherwise("unknown").alias("precision"),
    )


def extract_entities(articles: DataFrame, n: int = 15) -> DataFrame:
    """(event_id, name, mentions): the n most mentioned names, first seen first on ties."""
    return top_n(entity_mentions(articles), ["event_id"], [F.desc("mentions"), F.asc("first"), F.asc("name")], n).drop("first")


def detect_conflicts(articles: DataFrame) -> DataFrame:
    """Numeric disagreements of events with at least two articles."""
    # an article states one number a field, so two numbers are two articles
    return field_conflicts(articles.filter("event_id is not null"))


def verify(articles: DataFrame, sources: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(event_id, verdict, groups, official): two publisher groups and an official source verify; a conflict disputes."""
    f = verification_facts(articles, sources)
    several, official = F.col("groups") >= 2, F.col("official") > 0
    verdict = F.when(several & official, "VERIFIED").when(several | official, "UNCERTAIN").otherwise("UNVERIFIED")
    if conflicts is not None:
        f = f.join(conflicts.select("event_id").distinct().withColumn("_c", F.lit(True)), "event_id", "left")
        verdict = F.when(F.col("_c"), "DISPUTED").otherwise(verdict)
    return f.select("event_id", verdict.alias("verdict"), "groups", "official")


def claim_buckets(articles: DataFrame, sources: DataFrame, category: str = "war_conflict") -> DataFrame:
    """(event_id, bucket, statements) for one category: attributed statements are CLAIMED whoever reports them."""
    a = articles.filter(F.col("category") == category).join(sources, "source_id")
    text = F.concat_ws(" ", "title", "summary")
    bucket = F.when(is_attributed(text), "CLAIMED").when(F.col("origin_type").isin(OFFICIAL), "CONFIRMED").otherwise("UNVERIFIED")
    return a.groupBy("event_id", bucket.alias("bucket")).agg(F.sort_array(F.collect_list("title")).alias("statements"))


def natural_event_facts(articles: DataFrame) -> DataFrame:
    """(event_id, measures, lat, lon): measurements copied from providers and the first coordinates; events without either go."""
    m = first_measurements(articles).groupBy("event_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("measure", "value")))).alias("measures"))
    c = articles.filter("lat is not null and lon is not null").groupBy("event_id").agg(F.min_by(F.struct("lat", "lon"), F.struct("published_at", "article_id")).alias("c"))
    return m.join(c, "event_id", "full").select("event_id", "measures", "c.lat", "c.lon")


# Kinds of grounded claims.
CLAIM_KINDS = ["FACT", "STATEMENT", "CLAIMED", "MEASUREMENT", "OPINION"]


def _sent(df: DataFrame) -> DataFrame:
    """df (narrow rows), marked for broadcast only if it has at most BROADCAST_WINDOWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else df


def cited_passages(passages: DataFrame, articles: DataFrame, words: int = 8) -> DataFrame:
    """(run_id, article_id): the articles that share `words` words in a row, or all inner words of a shorter one, with a passage.

    passages: (run_id, quote). The first and last word of a quote may be parts of words in an article, so windows
    are cut from the words between them; every article that holds a quote shares all of these. A quote of one or
    two words is looked for in every article. What is found is a candidate: `ground_quotes` tests it.
    """
    hay = articles.select("article_id", fold_text(F.concat_ws(" ", "title", "summary")).alias("_hay"))

    def windows(k: str, size: int):
        return F.when(F.size(k) >= size, F.transform(F.sequence(F.lit(1), F.size(k) - size + 1), lambda i: F.xxhash64(F.slice(k, i, size))))

    q = passages.select("run_id", fold_text(F.col("quote")).alias("_quote")).filter("_quote <> ''").withColumn("_k", F.split("_quote", " "))
    q = saved(q.withColumn("_size", F.least(F.lit(words), F.size("_k") - 2)))
    found = []
    # at most `words` sizes and one for the shortest
    for size in sorted({max(0, r["_size"]) for r in q.select("_size").distinct().collect()}):
        if size:
            inner = q.filter(F.col("_size") == size).select("run_id", F.slice("_k", 2, F.size("_k") - 2).alias("_k"))
            mine = _sent(inner.select("run_id", F.explode(windows("_k", size)).alias("_w")).distinct())
            each = hay.select("article_id", F.split("_hay", " ").alias("_k")).select("article_id", F.explode(windows("_k", size)).alias("_w"))
            found.append(each.join(mine, "_w").select("run_id", "article_id"))
        else:
            found.append(hay.join(_sent(q.filter("_size <= 0").select("run_id", "_quote")), F.col("_hay").contains(F.col("_quote"))).select("run_id", "article_id"))
    none = passages.limit(0).select("run_id").crossJoin(articles.limit(0).select("article_id"))
    for f in found:
        none = none.unionByName(f)
    return none.distinct()


def ground_passages(passages: DataFrame, articles: DataFrame) -> DataFrame:
    """(run_id, article_id, kept, ...): each passage (run_id, quote) against every article that it shares words with; no cap."""
    cited = saved(cited_passages(passages, articles))
    held = articles.join(_sent(cited.select("article_id").distinct()), "article_id", "left_semi")
    claims = cited.join(_sent(passages.select("run_id", "quote")), "run_id").withColumns({"claim_no": F.col("article_id"), "kind": F.lit("FACT")})
    return ground_quotes(claims, held, None)


def ground_quotes(claims: DataFrame, articles: DataFrame, most: int | None = 40) -> DataFrame:
    """claims (run_id, claim_no, article_id, quote, kind) with `kept` and `why`; the first `most` of a run are checked.

    A quote must occur, folded, in the title and summary of the article that it cites. With `most` None all are checked.
    """
    hay = articles.select("article_id", fold_text(F.concat_ws(" ", "title", "summary")).alias("_hay"))
    q = claims if most is None else top_n(claims, ["run_id"], [F.asc("claim_no")], most)
    q = q.join(hay, "article_id", "left")
    folded = fold_text(F.col("quote"))
    why = (
        F.when(F.col("_hay").isNull(), "no_such_article")
        .when(F.length(F.trim("quote")) < 12, "too_short")
        .when(~F.upper("kind").isin(CLAIM_KINDS), "unknown_kind")
        .when((folded == "") | ~F.col("_hay").contains(folded), "not_in_article")
    )
    return q.withColumn("why", why).withColumn("kept", F.col("why").isNull()).drop("_hay")


def run_status(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """(run_id, proposed, kept, status): the ratio divides by all proposed; under half is blocked, none insufficient."""
    proposed = claims.groupBy("run_id").agg(F.count("*").alias("proposed"))
    kept = checked.groupBy("run_id").agg(F.count_if("kept").alias("kept"))
    out = proposed.join(kept, "run_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("status", F.when(F.col("kept") == 0, "insufficient").when(F.col("kept") * 2 < F.col("proposed"), "blocked").otherwise("ok"))
