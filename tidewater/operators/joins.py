"""Joins of articles, sources, events, scores, views, rules and edges (J1-J21), and set measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import haversine_km, hours_between, sphere_cell
from ..saved import if_small, saved
from .aggregates import pivot_scores, view_counts
from .windows import latest, top_n


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Inner, many to one. The size of sources decides the strategy: Spark broadcasts a side that it measures as small."""
    return articles.join(sources, "source_id")


def with_health(sources: DataFrame, health: DataFrame) -> DataFrame:
    return sources.join(health, "source_id", "left")


def timeline_rows(timeline: DataFrame, sources: DataFrame, articles: DataFrame) -> DataFrame:
    return timeline.join(sources, "source_id", "left").join(articles, "article_id", "left").orderBy("event_id", "at", "article_id")


def with_scores(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Events with a column for each kind's latest score."""
    return events.join(pivot_scores(latest(scores, ["event_id", "kind"], "computed_at", "id")), "event_id", "left")


def with_views(events: DataFrame, views: DataFrame, as_of: Column) -> DataFrame:
    counts = view_counts(views, as_of)
    return events.drop("views_total", "views_24h").join(counts, "event_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("views_total", "views_24h")})


def needs_review(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Events never reviewed, or active since their last review."""
    last = reviews.groupBy("event_id").agg(F.max("reviewed_at").alias("_last"))
    return events.join(last, "event_id", "left").filter("_last is null or last_activity_at > _last").drop("_last")


def having_match(events: DataFrame, children: DataFrame, condition: Column) -> DataFrame:
    return events.join(children.filter(condition).select("event_id"), "event_id", "left_semi")


def not_notified(matches: DataFrame, notifications: DataFrame) -> DataFrame:
    keys = ["user_id", "rule_id", "event_id"]
    return matches.join(notifications.select(*keys), keys, "left_anti")


def unreferenced(rows: DataFrame, key: str, *refs: DataFrame) -> DataFrame:
    """Rows that no reference names; null keys reference nothing, so plain anti joins do."""
    return reduce(lambda r, ref: r.join(ref.select(F.col(ref.columns[0]).alias(key)).filter(F.col(key).isNotNull()), key, "left_anti"), refs, rows)


def rule_matches(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Every enabled rule with the events it accepts; a rule's null dimension accepts all.

    Rules meet events by what they name: category and country, or one of them. Rules that name neither meet events
    by their least confidence, in steps of ten: an event is dealt to each step that it reaches (11 at most, and none).
    """
    r = rules.filter("enabled").select("user_id", "rule_id", F.col("category").alias("r_category"), F.upper("country").alias("r_country"), "min_confidence", "min_impact", "min_relevance", "only_verified")
    thresholds = (
        (F.coalesce(F.col("confidence"), F.lit(-1)) >= F.coalesce("min_confidence", F.lit(-1)))
        & (F.coalesce(F.col("life_impact"), F.lit(-1)) >= F.coalesce("min_impact", F.lit(-1)))
        & (F.coalesce(F.col("relevance"), F.lit(-1)) >= F.coalesce("min_relevance", F.lit(-1)))
        & (~F.coalesce(F.col("only_verified"), F.lit(False)) | (F.col("verification") == "VERIFIED"))
    )
    same_category, same_country = F.col("r_category") == F.col("category"), F.col("r_country") == F.col("country")
    step = lambda c: F.floor(F.greatest(F.lit(-1), F.least(F.lit(100), F.coalesce(c, F.lit(-1)))) / F.lit(10)).cast("int")
    levels = F.sequence(F.lit(-1), step(F.col("confidence")))
    open_ = r.filter("r_category is null and r_country is null").withColumn("_level", step(F.col("min_confidence")))
    parts = [
        events.join(r.filter("r_category is not null and r_country is not null"), same_category & same_country),
        events.join(r.filter("r_category is not null and r_country is null"), same_category),
        events.join(r.filter("r_category is null and r_country is not null"), same_country),
        events.withColumn("_level", F.explode(levels)).join(open_, "_level").drop("_level"),
    ]
    return concat(parts).filter(thresholds)


def followed(events: DataFrame, follows: DataFrame, order: list[Column] | None = None, n: int | None = None) -> DataFrame:
    """(user_id, event columns): events of followed categories, countries or ids, each event once a user.

    With an order and n, each category's and country's first n events only: a user's own first n are among them,
    and what is joined doesn't grow with the events of a category times those who follow it.
    """
    f = lambda kind: follows.filter(F.col("kind") == kind).select("user_id", F.col("target").alias("_t")).distinct()
    found = []
    for kind, c in (("category", F.col("category")), ("country", F.col("country")), ("event", F.col("event_id").cast("string"))):
        rows = events.withColumn("_t", c).filter("_t is not null")
        if n is not None and kind != "event":
            rows = if_small(saved(top_n(rows, ["_t"], order, n)))
        found.append(rows.join(f(kind), "_t").drop("_t"))
    return concat(found).dropDuplicates(["user_id", "event_id"])


def bookmarked(bookmarks: DataFrame, events: DataFrame, n: int = 30) -> DataFrame:
    return top_n(bookmarks.join(events, "event_id"), ["user_id"], [F.desc("bookmarked_at"), F.asc("event_id")], n)


def inbox(notifications: DataFrame, events: DataFrame, n: int = 50) -> DataFrame:
    return top_n(notifications.join(events, "event_id"), ["user_id"], [F.desc("created_at"), F.asc("event_id"), F.asc("rule_id")], n)


def neighbours(edges: DataFrame, events: DataFrame, n: int = 8) -> DataFrame:
    """Published events one edge away from either end: the n strongest, newest first on ties."""
    both = edges.select(F.col("from_id").alias("event_id"), F.col("to_id").alias("other_id"), "kind", "strength").unionByName(
        edges.select(F.col("to_id").alias("event_id"), F.col("from_id").alias("other_id"), "kind", "strength")
    )
    other = events.filter("status = 'PUBLISHED'").select(F.col("event_id").alias("other_id"), F.col("title").alias("other_title"), F.col("last_activity_at").alias("other_activity"))
    return top_n(both.join(other, "other_id"), ["event_id"], [F.desc("strength"), F.desc("other_activity"), F.asc("other_id"), F.asc("kind")], n)


def content_dups(articles: DataFrame) -> DataFrame:
    """(article_id, first_article_id) of articles whose content hash an earlier article has.

    Hashes are formed once and saved, as is the side of repeated hashes, so that Spark can split a hash that very many have.
    """
    rows = saved(articles.select("article_id", "content_hash", "published_at"))
    first = rows.groupBy("content_hash").agg(F.min(F.struct("published_at", "article_id")).alias("_f"), F.count("*").alias("_n")).filter("_n > 1")
    first = if_small(saved(first.select("content_hash", F.col("_f.article_id").alias("first_article_id"))))
    return rows.join(first, "content_hash").filter("article_id <> first_article_id").select("article_id", "first_article_id")


def provider_matches(articles: DataFrame) -> DataFrame:
    """(article_id, first_article_id) by source and the provider's event id in the payload, earliest first."""
    keyed = articles.withColumn("provider_event_id", F.get_json_object("payload", "$.measurements.provider_event_id")).filter("provider_event_id is not null")
    keys = ["source_id", "provider_event_id"]
    keyed = saved(keyed.select(*keys, "article_id", "published_at"))
    first = keyed.groupBy(*keys).agg(F.min(F.struct("published_at", "article_id")).alias("_f"), F.count("*").alias("_n")).filter("_n > 1")
    first = if_small(saved(first.select(*keys, F.col("_f.article_id").alias("first_article_id"))))
    return keyed.join(first, keys).filter("article_id <> first_article_id").select("article_id", "first_article_id")


def edges_with_titles(edges: DataFrame, events: DataFrame, n: int = 8) -> DataFrame:
    a = events.select(F.col("event_id").alias("from_id"), F.col("title").alias("from_title"))
    b = events.select(F.col("event_id").alias("to_id"), F.col("title").alias("to_title"))
    return edges.join(a, "from_id").join(b, "to_id").orderBy(F.desc("strength"), "from_id", "to_id", "kind").limit(n)


def open_reviews(queue: DataFrame, events: DataFrame) -> DataFrame:
    return queue.filter("state = 'open'").join(events, "event_id")


def radius_join(a: DataFrame, b: DataFrame, km: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a (id, lat, lon) and b (id, lat, lon) under `km` apart, with `km`: cells of a cube grid meet by equality.

    Rows meet only where the columns `keys`, which both have, are equal too (a window of time, a category).

    Cells have the radius as their side, so a place's partners lie in its cell or the 26 around it; poles and the
    date line need no special case. Rows without coordinates take no part.
    """
    ok = "lat is not null and lon is not null and lat between -90 and 90 and lon between -180 and 180"
    near = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    left = a.filter(ok).select(*keys, F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), sphere_cell(F.col("lat"), F.col("lon"), km).alias("c"))
    left = left.withColumn("d", F.explode(near)).select(*keys, "a_id", "a_lat", "a_lon", *[(F.col(f"c.{k}") + F.col(f"d.{k}")).alias(k) for k in "xyz"])
    right = b.filter(ok).select(*keys, F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), sphere_cell(F.col("lat"), F.col("lon"), km).alias("c")).select(*keys, "b_id", "b_lat", "b_lon", "c.x", "c.y", "c.z")
    d = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return left.join(right, [*keys, "x", "y", "z"]).withColumn("km", d).filter(F.col("km") < km).select("a_id", "b_id", "km")


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def shared(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def weighted_jaccard(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs (a, b) with similarity: summed weights of shared tokens over those of all; a missing weight counts 1.

    left and right: (id, token), distinct; weights: (token, idf). Pairs without shared tokens get 0.
    """
    weighed = lambda side, key: side.select(F.col("id").alias(key), "token").join(weights, "token", "left").select(key, "token", F.coalesce("idf", F.lit(1.0)).alias("w"))
    wl, wr = weighed(left, "a"), weighed(right, "b")
    sums = pairs.join(wl.groupBy("a").agg(F.sum("w").alias("wa")), "a", "left").join(wr.groupBy("b").agg(F.sum("w").alias("wb")), "b", "left")
    both = pairs.join(wl, "a").join(wr.select("b", "token"), ["b", "token"]).groupBy("a", "b").agg(F.sum("w").alias("shared"))
    out = sums.join(both, ["a", "b"], "left").withColumn("_s", F.coalesce("shared", F.lit(0.0)))
    total = F.coalesce("wa", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0)) - F.col("_s")
    return out.select("a", "b", F.when(total > 0, F.col("_s") / total).otherwise(0.0).alias("similarity"))


def candidates(articles: DataFrame, events: DataFrame, hours: float = 48) -> DataFrame:
    """(article_id, event_id, shared): events of the article's category (any, if it has none) that share a token with it.

    The event must have been active after the article's time less `hours`. No cap on partners: a pair without a
    shared token can't reach the similarity that clustering asks for.
    """
    from ..functions.text import tokens

    a = articles.select("article_id", "category", "published_at", F.explode(tokens(F.concat_ws(" ", "title", "summary"))).alias("token"))
    e = events.select("event_id", F.col("category").alias("e_category"), "last_activity_at", F.explode(tokens(F.col("title"))).alias("token"))
    near = hours_between(F.col("last_activity_at"), F.col("published_at")) > -hours
    any_ = a.filter("category = 'unclassified'").join(e, "token")
    own = a.join(e, (a["token"] == e["token"]) & (a["category"] == e["e_category"])).drop(e["token"]).filter("category <> 'unclassified'")
    return any_.unionByName(own.select(any_.columns)).filter(near).groupBy("article_id", "event_id").agg(F.count("*").alias("shared"))
