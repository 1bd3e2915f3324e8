"""Clustering of articles into events (G3): exact hash, provider identity, similarity, else a new event.

Articles walk in time order in the sequential form: each joins the best earlier event or founds one. Here pairs
come from shared tokens; who founds an event is decided in rounds (an article with an earlier founder among its
neighbours is none; one whose earlier neighbours are all no founders is one), which gives the same founders as
the walk, and long chains that rounds leave are walked; then each other article joins its best founder. Rounds are
saved to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import haversine_km, hours_between
from ..functions.text import tokens
from ..operators.joins import content_dups, jaccard, provider_matches
from ..saved import if_small, saved
from ..streaming.limits import prepare
from .components import components

THRESHOLD, WINDOW_HOURS = 0.30, 48.0
#: What sharing two strong words adds to a similarity, and what a place can.
STRONG, LOCATED, SAME_COUNTRY = 0.12, 0.10, 0.06


def similarity() -> Column:
    """Of an article (columns prefixed a_) and an earlier one standing for an event (b_)."""
    both = F.array_intersect("a_title_tokens", "b_title_tokens")
    strong = F.size(F.filter(both, is_strong)) >= 2
    located = F.col("a_lat").isNotNull() & F.col("b_lat").isNotNull()
    place = F.when(located, LOCATED).when(F.col("a_country") == F.col("b_country"), SAME_COUNTRY).otherwise(0.0)
    base = F.greatest(jaccard(F.col("a_title_tokens"), F.col("b_title_tokens")), jaccard(F.col("a_body_tokens"), F.col("b_title_tokens")) * 0.9)
    return base + F.when(strong, STRONG).otherwise(0.0) + place


def blocked() -> Column:
    """Too far apart, or in different countries where a place is missing, or different events of a provider."""
    located = F.col("a_lat").isNotNull() & F.col("b_lat").isNotNull()
    far = located & (haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) > 250)
    abroad = ~located & F.col("a_country").isNotNull() & F.col("b_country").isNotNull() & (F.col("a_country") != F.col("b_country"))
    other = F.col("a_provider").isNotNull() & F.col("b_provider").isNotNull() & (F.col("a_provider") != F.col("b_provider"))
    return F.coalesce(far, F.lit(False)) | F.coalesce(abroad, F.lit(False)) | F.coalesce(other, F.lit(False))


#: So much of a body is read for its words.
BODY = 400


def describe(articles: DataFrame) -> DataFrame:
    """What similarity needs of articles: id, published_at, category, place, provider's id, words of title and of title and body."""
    body = F.concat_ws(" ", F.col("title"), F.substring(F.coalesce("summary", F.lit("")), 1, BODY))
    return articles.select(
        F.col("article_id").alias("id"), "published_at", "category", "lat", "lon", F.col("geo_country").alias("country"),
        F.get_json_object("payload", "$.measurements.provider_event_id").alias("provider"), tokens(F.col("title")).alias("title_tokens"), tokens(body).alias("body_tokens"),
    )


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, df) over titles. It only orders words, the rarest first, so any table of counts gives the same pairs."""
    return rows.select(F.explode("title_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


#: Sets of 2 ** k to 2 ** (k + 1) - 1 words are of size k; a set has fewer than 2 ** SIZES words.
SIZES = 16


def meeting_words(rows: DataFrame, counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, published_at, category, reach, role, token, place, n, own, other): words of described rows by which alike pairs meet.

    A pair scores its likeness, 0.12 for two shared strong words and at most 0.10 for its place, so it is alike in
    one of three ways, each with words of its own: titles as alike as `threshold` less the place asks (role T), a body
    and a title likewise (B for the body, b for the title), or two strong words in common (S). Sets of n and m words of
    likeness t share t / (1 + t) * (n + m) words, and so one of all but the most frequent so many less one of each.
    How many these are depends on the other's size, so a row has its words for each size that the other may have:
    own and other are the two. place is a word's place among the row's n, the rarest first; reach is what the row's
    place can add.
    """
    reach = F.when(F.col("lat").isNotNull(), LOCATED).when(F.col("country").isNotNull(), SAME_COUNTRY).otherwise(0.0)
    each = [rows.select("id", F.lit(k).alias("kind"), F.explode(c).alias("token")) for k, c in (("t", "title_tokens"), ("b", "body_tokens"))]
    seen = each[0].unionByName(each[1]).join(if_small(counts), "token", "left")
    words = seen.groupBy("id", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), lambda x: x["token"]).alias("words"))
    words = words.join(rows.select("id", "published_at", "category", reach.alias("reach")), "id").withColumn("n", F.size("words"))
    ways = F.when(F.col("kind") == "b", F.array(_way("B", F.lit(threshold) - F.col("reach"), 0.9))).otherwise(F.array(_way("T", F.lit(threshold) - F.col("reach"), 1.0), _way("b", F.lit(threshold) - F.col("reach"), 0.9)))
    size = F.floor(F.log2("n")).cast("int")
    # words that are shared, at the least, with a set of the smallest of each size
    shared = F.ceil(F.col("way.t") / (1 + F.col("way.t")) * (F.col("n") + F.pow(2, F.col("other"))) - 1e-9)
    alike = words.select("*", F.explode(ways).alias("way")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SIZES - 1))).alias("other"))
    alike = alike.withColumn("shared", F.greatest(shared, F.lit(1))).filter((F.col("shared") <= F.col("n")) & (F.col("shared") < F.pow(2, F.col("other") + 1)))
    columns = ["id", "published_at", "category", "reach"]
    alike = alike.select(*columns, F.col("way.role").alias("role"), F.posexplode(F.slice("words", F.lit(1), (F.col("n") - F.col("shared") + 1).cast("int"))).alias("place", "token"), "n", size.alias("own"), "other")
    strong = words.filter("kind = 't'").withColumn("strong", F.filter("words", is_strong)).filter("size(strong) >= 2")
    strong = strong.select(*columns, F.lit("S").alias("role"), F.posexplode(F.slice("strong", F.lit(1), F.size("strong") - 1)).alias("place", "token"), "n", F.lit(0).alias("own"), F.lit(0).alias("other"))
    return alike.unionByName(strong)


def _way(role: str, least: Column, share: float) -> Column:
    return F.struct(F.lit(role).alias("role"), (least / share).alias("t"))


def is_strong(token: Column) -> Column:
    return (F.length(token) >= 7) | token.rlike("[0-9]")


def window_of(at: Column, hours: float) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(int(hours * 3_600_000_000))).cast("long")


def meetings(left: DataFrame, right: DataFrame, threshold: float, near: Column) -> DataFrame:
    """(a_id, b_id) once: pairs of `left` (later or new) and `right` that share a meeting word and may be alike.

    Both have meeting words and `w`, a window of time in which they meet; near holds for their columns prefixed a_ and
    b_. Articles without a category meet all others. At the rarest word that a pair shares, it can't share more than
    what either has from there on, which bounds the likeness once more.
    """
    names = ("id", "published_at", "category", "reach", "place", "n")
    a = left.filter("role <> 'b'").select(*[F.col(c).alias(f"a_{c}") for c in names], "token", "w", F.when(F.col("role") == "B", "b").otherwise(F.col("role")).alias("role"), F.col("own").alias("a_size"), F.col("other").alias("b_size"))
    b = right.filter("role <> 'B'").select(*[F.col(c).alias(f"b_{c}") for c in names], "token", "w", "role", F.col("own").alias("b_size"), F.col("other").alias("a_size"))
    keys = ["token", "w", "role", "a_size", "b_size"]
    known = a.filter("a_category <> 'unclassified'").withColumn("b_category", F.col("a_category")).join(b, [*keys, "b_category"])
    is_open = a.filter("a_category = 'unclassified'")
    least = F.lit(threshold) - F.least("a_reach", "b_reach")
    least = F.when(F.col("role") == "b", least / 0.9).otherwise(least)
    left_over = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    enough = (F.col("role") == "S") | (left_over >= least / (1 + least) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    # the other side isn't dealt again for nothing
    met = known if is_open.isEmpty() else known.unionByName(is_open.join(b, keys).select(known.columns))
    return met.filter(near & enough).select("a_id", "b_id").distinct()


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a_id, b_id) with `score`, as columns a_ and b_ of both described sides; those not blocked that reach the threshold."""
    side = lambda rows, s: rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns])
    full = pairs.join(side(left, "a"), "a_id").join(side(right, "b"), "b_id").filter(~blocked())
    return full.withColumn("score", similarity()).filter(F.col("score") >= threshold)


def similar_pairs(articles: DataFrame, threshold: float = THRESHOLD, hours: float = WINDOW_HOURS) -> DataFrame:
    """(later, earlier, score, earlier_at, later_at): pairs of articles that may form one event.

    Pairs meet by their rarest words (meeting_words), are counted once and then scored.
    """
    if threshold <= STRONG + LOCATED:
        raise ValueError("at such a threshold pairs are alike by their bonuses alone")
    rows = saved(describe(articles))
    words = saved(meeting_words(rows, saved(token_counts(rows)), threshold))
    # an earlier article lies in the later one's window of time or in the one before
    own = window_of(F.col("published_at"), hours)
    near = (F.struct("b_published_at", "b_id") < F.struct("a_published_at", "a_id")) & (hours_between(F.col("a_published_at"), F.col("b_published_at")) < hours)
    pairs = saved(meetings(words.withColumn("w", own), words.withColumn("w", F.explode(F.array(own, own + 1))), threshold, near))
    return scored(pairs, rows, rows, threshold).select(F.col("a_id").alias("later"), F.col("b_id").alias("earlier"), "score", F.col("b_published_at").alias("earlier_at"), F.col("a_published_at").alias("later_at"))


#: Rounds before what is left undecided is walked in order.
ROUNDS = 8


def founders(ids: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id): the first maximal independent set in time order. ids: (id); pairs: (later, earlier, later_at).

    Most articles are decided in few rounds. Long chains of articles, each like the one before, settle one link a
    round, so what is left after `rounds` is walked: each connected group of undecided articles in time order,
    streamed through a task that holds no more than the group's founders.
    """
    undecided = saved(ids)
    open_pairs = saved(pairs.select("later", "earlier", "later_at"))
    found = None
    for _ in range(rounds):
        # no open earlier neighbour: a founder
        new = saved(undecided.join(open_pairs.select(F.col("later").alias("id")), "id", "left_anti"))
        found = new if found is None else found.unionByName(new)
        # a founder's later neighbours are none
        no = open_pairs.join(new.select(F.col("id").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("id")).distinct()
        undecided = saved(undecided.join(new, "id", "left_anti").join(no, "id", "left_anti"))
        if undecided.isEmpty():
            return found
        rest = undecided.select("id")
        open_pairs = saved(open_pairs.join(rest.withColumnRenamed("id", "later"), "later", "left_semi").join(rest.withColumnRenamed("id", "earlier"), "earlier", "left_semi"))
    walked = _walked(undecided, open_pairs)
    return walked if found is None else found.unionByName(walked)


def _walked(undecided: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id): founders among the undecided, each group's articles taken in time order."""
    prepare(undecided)
    group = saved(components(pairs.select(F.col("later").alias("a"), F.col("earlier").alias("b"))))
    before = pairs.groupBy("later").agg(F.collect_list("earlier").alias("before"), F.min("later_at").alias("at")).withColumnRenamed("later", "id")
    rows = undecided.join(group.withColumnRenamed("node", "id"), "id", "left").join(before, "id", "left")
    rows = rows.select(F.coalesce("component", "id").alias("component"), F.col("at"), "id", F.coalesce("before", F.array().cast(before.schema["before"].dataType)).alias("before"))
    # the first of a group has no earlier neighbour and so no time
    rows = rows.repartition("component").sortWithinPartitions("component", F.asc_nulls_first("at"), "id").select("component", "id", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, set()
        for b in batches:
            keep = []
            for c, i, earlier in zip(*(b.column(k).to_pylist() for k in range(3))):
                if c != now:
                    now, heads = c, set()
                first = heads.isdisjoint(earlier)
                if first:
                    heads.add(i)
                keep.append(first)
            if any(keep):
                yield b.select(["id"]).filter(pa.array(keep))

    return rows.mapInArrow(run, undecided.select("id").schema)


def cluster(articles: DataFrame, threshold: float = THRESHOLD, hours: float = WINDOW_HOURS) -> DataFrame:
    """(article_id, event_article_id, how): each article with the article that founded its event; how it got there.

    articles: (article_id, source_id, title, summary, category, published_at, lat, lon, geo_country, payload,
    content_hash). Rows without a publish time found events of their own or follow exact duplicates.
    """
    dups = saved(content_dups(articles))
    # what follows reads so much of an article, and hashes are formed once, above
    slim = articles.select("article_id", "source_id", "title", F.substring("summary", 1, BODY).alias("summary"), "category", "published_at", "lat", "lon", "geo_country", "payload")
    kept = slim.join(dups.select("article_id"), "article_id", "left_anti")
    provider = saved(provider_matches(kept))
    left = saved(kept.join(provider.select("article_id"), "article_id", "left_anti"))
    pairs = saved(similar_pairs(left, threshold, hours))
    heads = saved(founders(left.select(F.col("article_id").alias("id")), pairs))
    to_heads = pairs.join(heads.select(F.col("id").alias("earlier")), "earlier", "left_semi").join(heads.select(F.col("id").alias("later")), "later", "left_anti")
    best = to_heads.groupBy("later").agg(F.max_by("earlier", F.struct("score", "earlier_at", "earlier")).alias("head"))
    direct = heads.select(F.col("id").alias("article_id"), F.col("id").alias("event_article_id"), F.lit("new").alias("how")).unionByName(
        best.select(F.col("later").alias("article_id"), F.col("head").alias("event_article_id"), F.lit("similar").alias("how"))
    )
    direct = saved(direct)
    follow = lambda rows, where, how: rows.join(where.select(F.col("article_id").alias("first_article_id"), "event_article_id"), "first_article_id").select("article_id", "event_article_id", F.lit(how).alias("how"))
    by_provider = direct.unionByName(follow(provider, direct, "provider"))
    return by_provider.unionByName(follow(dups, by_provider, "duplicate"))
