"""Queries over events, articles, sources, views, scores, rules and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import measures as M
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import rows as R
from ..operators import windows as W
from ..plans import enrich, graph, products, retention, review, scoring
from ..saved import if_small, saved
from ..sources import feeds, ledgers
from ..streaming import cycle, limits
from ..streaming import views as V
from . import query


def now():
    """The wall-clock of queries over orders; made when a query is, since columns need a session."""
    return T.at(T.AS_OF)


NOW = f"TIMESTAMP '{T.AS_OF}'"
NOW_V = f"TIMESTAMP '{T.AS_OF_EVENTS}'"

EV = """ev AS (SELECT o_orderkey AS event_id,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'war_conflict' WHEN '2' THEN 'natural_events' WHEN '3' THEN 'economy' WHEN '4' THEN 'politics' ELSE 'unclassified' END AS category,
  CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'SUPERVISOR_REVIEW' ELSE 'CLUSTERED' END AS status,
  n_name AS country, o_orderdate AS last_activity_at, o_orderdate AS published_at,
  'Event ' || o_orderkey || ' by ' || o_custkey AS title, o_custkey AS owner_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
AR = """ar AS (SELECT l_orderkey AS event_id, l_suppkey AS source_id, l_linenumber AS line, l_partkey AS part, l_shipdate AS published_at, n_name AS geo_country
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
SO = """so AS (SELECT s_suppkey AS source_id, s_name AS source_name, s_nationkey AS publisher_group,
  CASE s_suppkey % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'scientific' WHEN 2 THEN 'agency' ELSE 'press' END AS origin_type,
  CASE WHEN s_suppkey % 10 <> 9 THEN 60 + s_suppkey % 40 END AS reliability_score FROM supplier)"""
VW = """vw AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS event_id, user_id AS session, ts AS tm, event_id AS id, event_type = 'error' AS is_bot FROM events)"""
SC = """sc AS (SELECT user_id AS event_id, event_type AS kind, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value / 50) AS BIGINT) END AS value, ts AS computed_at, event_id AS id FROM events)"""
INPUTS = f"""{EV}, {AR}, {SO}, facts AS (
  SELECT event_id, count(*) AS article_count, count(DISTINCT publisher_group) AS independent_sources,
    count(DISTINCT CASE WHEN origin_type IN ('official', 'scientific') THEN source_id END) AS official_sources,
    max(reliability_score) AS max_reliability, avg(reliability_score) AS avg_reliability, count(DISTINCT geo_country) AS countries
  FROM ar JOIN so USING (source_id) GROUP BY event_id
), inp AS (
  SELECT ev.*, coalesce(article_count, 0) AS article_count, coalesce(independent_sources, 0) AS independent_sources, coalesce(official_sources, 0) AS official_sources,
    max_reliability, avg_reliability, coalesce(countries, 0) AS countries, coalesce(article_count, 0) AS timeline_points, owner_id % 3 AS conflicts
  FROM ev LEFT JOIN facts USING (event_id)
), scored AS (
  SELECT *, greatest(0, least(100, least(independent_sources, 5) * 12 + CASE WHEN official_sources > 0 THEN 25 ELSE 0 END + CAST(floor(max_reliability / 100.0 * 20 + 0.5) AS BIGINT)
    + CASE WHEN article_count >= 3 THEN 10 WHEN article_count = 2 THEN 6 ELSE 2 END - least(30, conflicts * 15))) AS confidence_raw,
    CASE category WHEN 'war_conflict' THEN 45 WHEN 'natural_events' THEN 45 WHEN 'economy' THEN 28 WHEN 'politics' THEN 20 END AS base,
    greatest(0, date_diff('second', last_activity_at, {NOW}) / 3600.0) AS age
  FROM inp
), sv AS (
  SELECT *, CASE WHEN max_reliability IS NOT NULL THEN confidence_raw END AS confidence,
    least(100, least(article_count, 8) * 6 + least(independent_sources, 5) * 7 + least(countries, 4) * 4
      + CASE WHEN age < 6 THEN 15 WHEN age < 24 THEN 10 WHEN age < 72 THEN 4 ELSE 0 END + least(timeline_points, 6) * 2) AS relevance,
    CASE WHEN base IS NOT NULL THEN least(100, base + least(countries, 4) * 5 + least(independent_sources, 4) * 3) END AS life_impact,
    CASE WHEN (CASE WHEN official_sources > 0 THEN 35 ELSE 0 END) + least(independent_sources, 4) * 10 - (CASE WHEN conflicts > 0 THEN 20 ELSE 0 END) > 0
      THEN least(100, (CASE WHEN official_sources > 0 THEN 35 ELSE 0 END) + least(independent_sources, 4) * 10 - (CASE WHEN conflicts > 0 THEN 20 ELSE 0 END)) END AS evidence_strength,
    CASE WHEN avg_reliability IS NOT NULL THEN greatest(0, least(100, CAST(floor(avg_reliability + 0.5) AS BIGINT))) END AS source_reliability,
    CASE WHEN independent_sources >= 2 AND official_sources > 0 THEN 'VERIFIED' WHEN independent_sources >= 2 OR official_sources > 0 THEN 'UNCERTAIN' ELSE 'UNVERIFIED' END AS verification
  FROM scored
)"""


def inputs(spark, d, events=None):
    """Score inputs of all events or of some (saved); only their articles are then read further."""
    a = T.articles(spark, d)
    if events is not None:
        a = a.join(if_small(events.select("event_id"), 1_000_000), "event_id", "left_semi")
    df = A.score_inputs(T.events(spark, d) if events is None else events, a, T.sources(spark, d), now())
    return df.withColumn("conflicts", F.col("owner_id") % 3)


def scored(spark, d, events=None):
    several, official = F.col("independent_sources") >= 2, F.col("official_sources") > 0
    return inputs(spark, d, events).withColumns(
        {
            "confidence": scoring.confidence(), "relevance": scoring.relevance(now()), "life_impact": scoring.life_impact(),
            "evidence_strength": scoring.evidence_strength(), "source_reliability": scoring.source_reliability(),
            "verification": F.when(several & official, "VERIFIED").when(several | official, "UNCERTAIN").otherwise("UNVERIFIED"),
        }
    )


@query("event_rollup", f"WITH {AR}, {SO} SELECT event_id, count(*) AS article_count, count(DISTINCT publisher_group) AS independent_sources FROM ar JOIN so USING (source_id) GROUP BY event_id")
def event_rollup(spark, d):
    return A.rollup(T.articles(spark, d), T.sources(spark, d))


@query("score_inputs", f"WITH {INPUTS} SELECT event_id, article_count, independent_sources, official_sources, max_reliability, countries, timeline_points, conflicts FROM inp")
def score_inputs(spark, d):
    return inputs(spark, d).select("event_id", "article_count", "independent_sources", "official_sources", "max_reliability", "countries", "timeline_points", "conflicts")


def _score(kind: str):
    @query(f"score_{kind}", f"WITH {INPUTS} SELECT event_id, CAST({kind} AS BIGINT) AS {kind} FROM sv")
    def run(spark, d):
        return scored(spark, d).select("event_id", kind)


for _k in ("confidence", "relevance", "life_impact", "evidence_strength", "source_reliability"):
    _score(_k)


@query(
    "score_trending",
    f"""WITH {VW}, g AS (SELECT event_id, max(tm) AS last_activity_at,
      count(*) FILTER (tm <= {NOW_V} AND tm > {NOW_V} - INTERVAL 24 HOUR AND NOT is_bot) AS v, count(*) FILTER (tm <= {NOW_V} - INTERVAL 24 HOUR AND tm > {NOW_V} - INTERVAL 48 HOUR AND NOT is_bot) AS p FROM vw GROUP BY event_id
    ), h AS (SELECT *, CASE WHEN p > 0 THEN v / p::DOUBLE ELSE 2.0 END AS growth, greatest(0, date_diff('microsecond', last_activity_at, {NOW_V}) / 3600000000.0) AS age FROM g)
    SELECT event_id, v AS views_24h, p AS views_prev_24h, CASE WHEN v > 0 THEN CAST(greatest(0, least(100, least(60, floor(log10(v + 1) * 30 + 0.5)) + least(25, floor((growth - 1) * 20 + 0.5))
      + CASE WHEN age < 3 THEN 15 WHEN age < 12 THEN 8 ELSE 0 END)) AS BIGINT) END AS trending FROM h""",
)
def score_trending(spark, d):
    as_of = T.at(T.AS_OF_EVENTS)
    v = T.views(spark, d).withColumn("counted", ~F.col("is_bot"))
    g = W.growth(v, as_of).join(v.groupBy("event_id").agg(F.max("at").alias("last_activity_at")), "event_id")
    return g.select("event_id", "views_24h", "views_prev_24h", scoring.trending(as_of).alias("trending"))


@query(
    "score_factors",
    f"""WITH {INPUTS} SELECT event_id, unnest(['publisher_groups', 'official_source', 'best_reliability', 'articles', 'conflicts']) AS factor,
      unnest([least(independent_sources, 5) * 12, CASE WHEN official_sources > 0 THEN 25 ELSE 0 END, CAST(floor(max_reliability / 100.0 * 20 + 0.5) AS BIGINT),
        CASE WHEN article_count >= 3 THEN 10 WHEN article_count = 2 THEN 6 ELSE 2 END, -least(30, conflicts * 15)]) AS contribution FROM sv""",
)
def score_factors(spark, d):
    rows = scoring.score_events(inputs(spark, d), now()).filter("kind = 'confidence'")
    return R.explode_factors(rows).select("event_id", "factor", "contribution")


@query("latest_scores", f"WITH {SC} SELECT event_id, kind, value, id FROM sc QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY computed_at DESC, id DESC) = 1")
def latest_scores(spark, d):
    return W.latest(T.scores(spark, d), ["event_id", "kind"], "computed_at", "id").select("event_id", "kind", "value", "id")


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "score_pivot",
    f"""WITH {SC}, l AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY computed_at DESC, id DESC) = 1)
    SELECT event_id, {", ".join(f"max(value) FILTER (kind = '{k}') AS {k}" for k in _KINDS)} FROM l GROUP BY event_id""",
)
def score_pivot(spark, d):
    return A.pivot_scores(W.latest(T.scores(spark, d), ["event_id", "kind"], "computed_at", "id"), _KINDS)


@query(
    "score_changes",
    f"""WITH {SC}, l AS (SELECT *, lag(value) OVER w AS old_value, row_number() OVER w AS r FROM sc WINDOW w AS (PARTITION BY event_id, kind ORDER BY computed_at, id))
    SELECT id, event_id, kind, old_value, value AS new_value, CASE WHEN r = 1 THEN 'initial' WHEN old_value IS NULL THEN 'became_known' WHEN value IS NULL THEN 'became_unknown' ELSE 'changed' END AS reason
    FROM l WHERE r = 1 OR value IS DISTINCT FROM old_value""",
)
def score_changes(spark, d):
    return W.score_changes(T.scores(spark, d)).select("id", "event_id", "kind", "old_value", "new_value", "reason")


@query(
    "state_transitions",
    """WITH l AS (SELECT event_id AS id, user_id AS event_id, event_type AS to_state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
    SELECT id, event_id, from_state, to_state FROM l WHERE to_state IS DISTINCT FROM from_state""",
)
def state_transitions(spark, d):
    return W.transitions(T.states(spark, d)).select("id", "event_id", "from_state", "to_state")


def _ordered(order: str, direction: str) -> None:
    cols = {"recent": "last_activity_at", "relevance": "relevance", "confidence": "confidence", "impact": "life_impact"}
    name = f"events_by_{order}" + ("_asc" if direction == "asc" else "")
    second = "" if order == "recent" else ", last_activity_at DESC NULLS LAST"

    @query(name, f"WITH {INPUTS} SELECT event_id, CAST(confidence AS BIGINT) AS confidence, CAST(life_impact AS BIGINT) AS life_impact FROM sv WHERE status = 'PUBLISHED' ORDER BY {cols[order]} {direction} NULLS LAST{second}, event_id LIMIT 30")
    def run(spark, d):
        return W.page(W.order_events(R.published(scored(spark, d)), order, direction)).select("event_id", "confidence", "life_impact")


for _o in ("recent", "relevance", "confidence", "impact"):
    for _d in ("desc", "asc"):
        _ordered(_o, _d)


@query(
    "events_filtered",
    f"WITH {INPUTS} SELECT event_id, country FROM sv WHERE status = 'PUBLISHED' AND category = 'economy' AND coalesce(confidence, -1) >= 60 AND date_diff('hour', last_activity_at, {NOW}) < 20000",
)
def events_filtered(spark, d):
    return R.list_events(scored(spark, d), now(), category="economy", since_hours=20000, min_confidence=60).select("event_id", "country")


@query(
    "event_freshness",
    f"""WITH {EV}, t AS (SELECT *, greatest(0, date_diff('hour', last_activity_at, {NOW})) AS h, CASE category WHEN 'war_conflict' THEN [2, 8, 24, 96] WHEN 'natural_events' THEN [1, 6, 24, 72]
      WHEN 'economy' THEN [6, 24, 72, 240] ELSE [6, 24, 96, 336] END AS lim FROM ev)
    SELECT event_id, CASE WHEN h < lim[1] THEN 'FRESH' WHEN h < lim[2] THEN 'RECENT' WHEN h < lim[3] THEN 'AGING' WHEN h < lim[4] THEN 'STALE' ELSE 'EXPIRED' END AS freshness,
      CASE WHEN h < 1 THEN 'seconds' WHEN h < 24 THEN h || ' h' ELSE (h // 24) || ' d' END AS relative FROM t""",
)
def event_freshness(spark, d):
    e = R.decorate(T.events(spark, d), now())
    return e.select("event_id", "freshness", M.relative_age(F.col("last_activity_at"), now()).alias("relative"))


_HOME = [
    ("breaking", f"date_diff('hour', last_activity_at, {NOW}) < 12", "", 6), ("trending", "true", "trending DESC NULLS LAST,", 6), ("top", "true", "relevance DESC NULLS LAST,", 8), ("natural", "category = 'natural_events'", "", 4),
    ("conflict", "category = 'war_conflict'", "", 4), ("economy", "category = 'economy'", "", 4), ("technology", "category = 'technology'", "", 4),
]
_TREND = f"""{VW}, g AS (SELECT event_id, max(tm) AS seen_at, count(*) FILTER (NOT is_bot AND tm > {NOW_V} - INTERVAL 24 HOUR AND tm <= {NOW_V}) AS v,
  count(*) FILTER (NOT is_bot AND tm > {NOW_V} - INTERVAL 48 HOUR AND tm <= {NOW_V} - INTERVAL 24 HOUR) AS p FROM vw GROUP BY event_id),
  tr AS (SELECT event_id, CASE WHEN v > 0 THEN CAST(greatest(0, least(100, least(60, floor(log10(v + 1) * 30 + 0.5)) + least(25, floor(((CASE WHEN p > 0 THEN v / p::DOUBLE ELSE 2.0 END) - 1) * 20 + 0.5))
    + CASE WHEN hours < 3 THEN 15 WHEN hours < 12 THEN 8 ELSE 0 END)) AS BIGINT) END AS trending FROM (SELECT *, greatest(0, date_diff('microsecond', seen_at, {NOW_V}) / 3600000000.0) AS hours FROM g))"""


def _with_trending(spark, d):
    as_of = T.at(T.AS_OF_EVENTS)
    v = T.views(spark, d).withColumn("counted", ~F.col("is_bot"))
    g = W.growth(v, as_of).join(v.groupBy("event_id").agg(F.max("at").alias("last_activity_at")), "event_id")
    return scored(spark, d).join(g.select("event_id", scoring.trending(as_of).alias("trending")), "event_id", "left")


@query(
    "home_lists",
    f"WITH {INPUTS}, {_TREND}, p AS (SELECT * FROM sv LEFT JOIN tr USING (event_id) WHERE status = 'PUBLISHED') "
    + " UNION ALL ".join(f"SELECT '{k}' AS list, rank, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {o} last_activity_at DESC, event_id) AS rank FROM p WHERE {c}) WHERE rank <= {n}" for k, c, o, n in _HOME),
)
def home_lists(spark, d):
    return products.home_lists(_with_trending(spark, d), now())


@query(
    "most_viewed",
    f"""WITH {INPUTS}, vt AS (SELECT event_id, count(*) AS views_total FROM vw2 GROUP BY event_id), p AS (SELECT *, coalesce(views_total, 0) AS n FROM sv LEFT JOIN vt USING (event_id) WHERE status = 'PUBLISHED' AND date_diff('hour', last_activity_at, {NOW}) < 9000)
    SELECT event_id, n AS views_total FROM p ORDER BY n DESC, last_activity_at DESC, event_id LIMIT 50""".replace("vw2", "(SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS event_id FROM events)"),
)
def most_viewed(spark, d):
    n = T.views(spark, d).groupBy("event_id").agg(F.count("*").alias("views_total"))
    e = scored(spark, d).join(n, "event_id", "left").withColumn("views_total", F.coalesce("views_total", F.lit(0)))
    return products.preset(e, "viewed", now(), "9000").select("event_id", "views_total")


@query(
    "preset_lists",
    f"""WITH {INPUTS}, {_TREND}, p AS (SELECT * FROM sv WHERE status = 'PUBLISHED')
    SELECT * FROM (SELECT 'all' AS list, event_id FROM p ORDER BY last_activity_at DESC, event_id LIMIT 60) UNION ALL
    SELECT * FROM (SELECT 'category' AS list, event_id FROM p WHERE category = 'politics' ORDER BY last_activity_at DESC, event_id LIMIT 50) UNION ALL
    SELECT * FROM (SELECT 'country' AS list, event_id FROM p WHERE country = 'NATION_3' ORDER BY last_activity_at DESC, event_id LIMIT 50) UNION ALL
    SELECT * FROM (SELECT 'today' AS list, event_id FROM p WHERE age < 24 AND last_activity_at <= {NOW} ORDER BY relevance DESC, last_activity_at DESC, event_id LIMIT 80) UNION ALL
    SELECT * FROM (SELECT 'breaking' AS list, event_id FROM p WHERE date_diff('hour', last_activity_at, {NOW}) < 6 ORDER BY last_activity_at DESC, event_id LIMIT 40) UNION ALL
    SELECT * FROM (SELECT 'trending' AS list, event_id FROM p JOIN tr USING (event_id) WHERE trending IS NOT NULL ORDER BY trending DESC, p.last_activity_at DESC, event_id LIMIT 50)""",
)
def preset_lists(spark, d):
    e = _with_trending(spark, d)
    named = [("all", None), ("category", "politics"), ("country", "NATION_3"), ("today", None), ("breaking", None), ("trending", None)]
    return J.concat([products.preset(e, n, now(), v).select(F.lit(n).alias("list"), "event_id") for n, v in named])


_ADMIT = f"""{VW}, w AS (SELECT *, lag(tm) OVER (PARTITION BY session, event_id ORDER BY tm, id) AS before,
    count(*) OVER (PARTITION BY session ORDER BY tm RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS day FROM vw),
  x AS (SELECT a.id, a.session, a.event_id, a.tm, a.is_bot, a.before, (SELECT count(*) FROM vw b WHERE b.session = a.session AND b.tm < a.tm AND b.tm > a.tm - INTERVAL 24 HOUR) AS prior FROM w a),
  adm AS (SELECT id, session, event_id, tm, CASE WHEN is_bot THEN 'bot_pattern' WHEN before IS NOT NULL AND tm - before < INTERVAL 5 DAY THEN 'dedupe_window' WHEN prior >= 5 THEN 'rate_limit' END AS reason FROM x)"""


def admitted(spark, d):
    return V.admit_views(T.views(spark, d), F.col("is_bot"), minutes=5 * 1440, limit=5, hours=24)


@query("views_admitted", f"WITH {_ADMIT} SELECT id, session, event_id, reason, reason IS NULL AS counted FROM adm")
def views_admitted(spark, d):
    return admitted(spark, d).select("id", "session", "event_id", "reason", "counted")


@query("view_counts", f"WITH {_ADMIT} SELECT event_id, count(*) FILTER (reason IS NULL) AS views_total, count(*) FILTER (reason IS NULL AND {NOW_V} - tm < INTERVAL 24 HOUR) AS views_24h FROM adm GROUP BY event_id")
def view_counts(spark, d):
    return A.view_counts(admitted(spark, d), T.at(T.AS_OF_EVENTS))


@query(
    "view_growth",
    f"""WITH {_ADMIT} SELECT event_id, count(*) FILTER (reason IS NULL AND tm <= {NOW_V} AND tm > {NOW_V} - INTERVAL 24 HOUR) AS views_24h,
    count(*) FILTER (reason IS NULL AND tm <= {NOW_V} - INTERVAL 24 HOUR AND tm > {NOW_V} - INTERVAL 48 HOUR) AS views_prev_24h FROM adm GROUP BY event_id""",
)
def view_growth(spark, d):
    return W.growth(admitted(spark, d), T.at(T.AS_OF_EVENTS))


@query("country_facets", f"WITH {EV} SELECT country, count(*) AS n FROM ev WHERE status = 'PUBLISHED' GROUP BY country ORDER BY n DESC, country LIMIT 30")
def country_facets(spark, d):
    return A.country_facets(T.events(spark, d))


@query("source_articles", "SELECT s_suppkey AS source_id, count(l_orderkey) AS articles FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def source_articles(spark, d):
    return A.articles_per_source(T.sources(spark, d), T.articles(spark, d))


@query(
    "system_counters",
    f"WITH {EV} SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM ev WHERE status = 'PUBLISHED') AS published, (SELECT count(*) FROM lineitem) AS articles, (SELECT count(*) FROM supplier) AS sources, (SELECT count(*) FROM events) AS views",
)
def system_counters(spark, d):
    e = T.events(spark, d)
    return A.system_counters({"events": (e, None), "published": (e, F.col("status") == "PUBLISHED"), "articles": (T.read(spark, d, "lineitem"), None), "sources": (T.sources(spark, d), None), "views": (T.views(spark, d), None)})


@query(
    "source_agreement",
    f"WITH {AR}, {SO} SELECT event_id, publisher_group::BIGINT AS publisher_group, count(DISTINCT source_name) AS names, min(source_name) AS first_name FROM ar JOIN so USING (source_id) GROUP BY event_id, publisher_group",
)
def source_agreement(spark, d):
    groups = A.source_agreement(T.articles(spark, d), T.sources(spark, d)).select("event_id", F.explode("groups").alias("publisher_group", "names"))
    return groups.select("event_id", "publisher_group", F.size("names").alias("names"), F.element_at("names", 1).alias("first_name"))


@query(
    "verification",
    f"""WITH {AR}, {SO}, f AS (SELECT event_id, count(DISTINCT publisher_group) AS groups, count(*) FILTER (origin_type IN ('official', 'scientific')) AS official FROM ar JOIN so USING (source_id) GROUP BY event_id)
    SELECT event_id, CASE WHEN groups >= 2 AND official > 0 THEN 'VERIFIED' WHEN groups >= 2 OR official > 0 THEN 'UNCERTAIN' ELSE 'UNVERIFIED' END AS verdict, groups, official FROM f""",
)
def verification(spark, d):
    return enrich.verify(T.articles(spark, d), T.sources(spark, d))


def _urls(spark, d):
    return T.articles(spark, d).withColumn("url", F.when(F.col("part") % 97 != 0, F.concat(F.lit("https://n.example/"), F.col("part").cast("string"))).otherwise(F.lit("ftp://n.example/")))


@query(
    "quality_gate",
    f"""WITH {INPUTS}, af AS (SELECT event_id, count(*) AS n, bool_and(part % 97 <> 0) AS urls FROM ar GROUP BY event_id), q AS (
      SELECT sv.*, coalesce(n, 0) AS n, coalesce(urls, false) AS urls FROM sv LEFT JOIN af USING (event_id)), r AS (
      SELECT *, CASE WHEN n = 0 OR NOT urls THEN 'BLOCK'
        WHEN confidence IS NULL OR coalesce(confidence, 0) < 30 OR (coalesce(life_impact, 0) >= 80 AND coalesce(confidence, 0) < 70) OR conflicts > 0 THEN 'REVIEW_REQUIRED' ELSE 'APPROVE' END AS decision FROM q), g AS (
      SELECT *, decision = 'APPROVE' AND n > 0 AND urls AND category <> 'unclassified' AND confidence IS NOT NULL AS publish FROM r)
    SELECT event_id, decision, publish, CASE WHEN NOT publish THEN CASE WHEN decision = 'BLOCK' THEN 90 ELSE 50 END END::BIGINT AS priority FROM g""",
)
def quality_gate(spark, d):
    e = scored(spark, d).drop("article_count")
    a = _urls(spark, d)
    titled = a.join(e.select("event_id", "title"), "event_id")
    s = review.supervise(e, titled, conflicts=e.filter("conflicts > 0"))
    return review.quality_gate(s).select("event_id", "decision", "publish", "priority")


@query(
    "review_queue",
    f"WITH {EV} SELECT event_id, priority FROM (SELECT event_id, CASE WHEN category = 'war_conflict' THEN 90 ELSE 50 END::BIGINT AS priority, last_activity_at FROM ev WHERE status = 'SUPERVISOR_REVIEW') ORDER BY priority DESC, last_activity_at, event_id LIMIT 100",
)
def review_queue(spark, d):
    q = T.events(spark, d).filter("status = 'SUPERVISOR_REVIEW'").select("event_id", F.when(F.col("category") == "war_conflict", 90).otherwise(50).alias("priority"), F.col("last_activity_at").alias("created_at"))
    return W.review_order(q).select("event_id", "priority")


@query(
    "needs_review",
    f"WITH {EV}, {AR}, r AS (SELECT event_id, max(published_at) AS last FROM ar WHERE line % 2 = 0 GROUP BY event_id) SELECT event_id FROM ev LEFT JOIN r USING (event_id) WHERE last IS NULL OR last_activity_at > last",
)
def needs_review(spark, d):
    reviews = T.articles(spark, d).filter("line % 2 = 0").select("event_id", F.col("published_at").alias("reviewed_at"))
    return J.needs_review(T.events(spark, d), reviews).select("event_id")


@query(
    "work_batch",
    f"WITH {EV}, {AR}, r AS (SELECT event_id, max(published_at) AS last FROM ar WHERE line % 2 = 0 GROUP BY event_id) SELECT event_id FROM ev LEFT JOIN r USING (event_id) WHERE last IS NULL OR last_activity_at > last ORDER BY last_activity_at DESC, event_id LIMIT 400",
)
def work_batch(spark, d):
    reviews = T.articles(spark, d).filter("line % 2 = 0").select("event_id", F.col("published_at").alias("reviewed_at"))
    return cycle.changed_events(T.events(spark, d), reviews).select("event_id")


@query(
    "event_detail",
    f"""WITH {EV}, {AR}, r AS (SELECT event_id, source_id, part, row_number() OVER (PARTITION BY event_id ORDER BY published_at DESC, line, part, source_id) AS no FROM ar)
    SELECT ev.event_id, count(no) AS shown, string_agg(source_id, ',' ORDER BY no) AS sources FROM ev LEFT JOIN (SELECT * FROM r WHERE no <= 3) r USING (event_id) WHERE status = 'PUBLISHED' GROUP BY ev.event_id""",
)
def event_detail(spark, d):
    a = T.articles(spark, d)
    out = products.event_detail(R.published(T.events(spark, d)).select("event_id"), {"articles": (a, [F.desc("published_at"), F.asc("line"), F.asc("part"), F.asc("source_id")], 3)})
    text = F.array_join(F.transform("articles", lambda x: x["source_id"].cast("string")), ",")
    return out.select("event_id", F.size("articles").alias("shown"), F.nullif(text, F.lit("")).alias("sources"))


_RULES = """ru AS (SELECT c_custkey AS user_id, c_custkey AS rule_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'war_conflict' WHEN 'MACHINERY' THEN 'natural_events' WHEN 'FURNITURE' THEN 'economy' WHEN 'HOUSEHOLD' THEN 'politics' END AS r_category,
  CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' || c_nationkey END AS r_country, CASE WHEN c_custkey % 2 = 0 THEN 40 + c_custkey % 50 END AS min_confidence,
  CASE WHEN c_custkey % 5 = 0 THEN 50 + c_custkey % 40 END AS min_impact, c_custkey % 7 = 0 AS only_verified FROM customer WHERE c_custkey % 11 <> 0)"""


@query(
    "alert_matches",
    f"""WITH {INPUTS}, {_RULES}, m AS (SELECT user_id, rule_id, event_id, published_at FROM ru JOIN sv ON (r_category IS NULL OR r_category = category) AND (r_country IS NULL OR r_country = country)
      AND coalesce(confidence, -1) >= coalesce(min_confidence, -1) AND coalesce(life_impact, -1) >= coalesce(min_impact, -1) AND (NOT only_verified OR verification = 'VERIFIED')
      WHERE status = 'PUBLISHED' AND published_at <= {NOW} AND date_diff('hour', published_at, {NOW}) < 1440 AND NOT (event_id % 13 = 0 AND owner_id = user_id))
    SELECT user_id, rule_id, event_id FROM m QUALIFY row_number() OVER (PARTITION BY user_id, rule_id ORDER BY published_at DESC, event_id) <= 25""",
)
def alert_matches(spark, d):
    return _alerts(spark, d, products.match_alerts).select("user_id", "rule_id", "event_id")


def _alerts(spark, d, tell):
    e = T.events(spark, d)
    # owners were told of every thirteenth of their events
    told = e.filter("event_id % 13 = 0").select(F.col("owner_id").alias("user_id"), F.col("owner_id").alias("rule_id"), "event_id")
    # only events that can be told of are scored
    fresh = saved(products.fresh_events(e, now(), 1440))
    return tell(T.rules(spark, d), scored(spark, d, fresh), told, now(), since_hours=1440)


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CATEGORY_LABELS.items())
_REASON = f"""coalesce(nullif(concat_ws(' · ', CASE r_category {_LABELS} END, 'country ' || r_country, CASE WHEN only_verified THEN 'only VERIFIED' END, 'confidence ≥ ' || min_confidence, 'life impact ≥ ' || min_impact), ''), 'no criteria')"""


@query("rule_texts", f"WITH {_RULES} SELECT rule_id, {_REASON} AS reason FROM ru")
def rule_texts(spark, d):
    return T.rules(spark, d).filter("enabled").select("rule_id", products.describe_rule().alias("reason"))


@query(
    "alert_reasons",
    f"""WITH {INPUTS}, {_RULES}, m AS (SELECT rule_id, {_REASON} AS reason FROM ru JOIN sv ON (r_category IS NULL OR r_category = category) AND (r_country IS NULL OR r_country = country)
      AND coalesce(confidence, -1) >= coalesce(min_confidence, -1) AND coalesce(life_impact, -1) >= coalesce(min_impact, -1) AND (NOT only_verified OR verification = 'VERIFIED')
      WHERE status = 'PUBLISHED' AND published_at <= {NOW} AND date_diff('hour', published_at, {NOW}) < 1440 AND NOT (event_id % 13 = 0 AND owner_id = user_id))
    SELECT reason, count(DISTINCT rule_id) AS rules, sum(n)::BIGINT AS alerts FROM (SELECT reason, rule_id, least(25, count(*)) AS n FROM m GROUP BY ALL) GROUP BY reason""",
)
def alert_reasons(spark, d):
    return _alerts(spark, d, products.alert_lists).groupBy("reason").agg(F.count_distinct("rule_id").alias("rules"), F.sum(F.size("event_ids")).alias("alerts"))


@query(
    "rule_counts",
    "WITH c AS (SELECT c_custkey % 50 AS user_id, count(*) AS rules, count(*) FILTER (c_custkey % 11 <> 0) AS enabled_rules FROM customer GROUP BY 1), m AS (SELECT o_custkey % 50 AS user_id, count(*) AS matches FROM orders GROUP BY 1) SELECT user_id, rules, enabled_rules, coalesce(matches, 0) AS matches FROM c LEFT JOIN m USING (user_id)",
)
def rule_counts(spark, d):
    r = T.rules(spark, d).withColumn("user_id", F.col("user_id") % 50)
    n = T.events(spark, d).select((F.col("owner_id") % 50).alias("user_id"))
    return A.rule_counts(r, n)


@query(
    "validated_rules",
    """SELECT c_custkey AS rule_id, CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 2 <> 0 AND c_custkey % 5 <> 0 THEN 'no_criterion' END AS error FROM customer""",
)
def validated_rules(spark, d):
    r = T.rules(spark, d)
    return products.validate_rules(r).select("rule_id", "error")


#: Briefs look at events that were published some hours before their last activity.
BRIEFED = f"p0 AS (SELECT * REPLACE (published_at - INTERVAL 1 HOUR * (event_id * 7 % 59) AS published_at) FROM sv), p AS (SELECT * FROM p0 WHERE status = 'PUBLISHED' AND published_at <= {NOW} AND epoch_us({NOW}) - epoch_us(published_at) < 2400 * 3600000000)"


def briefed(spark, d):
    return scored(spark, d).withColumn("published_at", F.timestamp_micros(F.unix_micros("published_at") - F.col("event_id") * 7 % 59 * 3_600_000_000))


@query(
    "brief_sections",
    f"""WITH {INPUTS}, {BRIEFED}, a AS (
      SELECT 'impact' AS section, event_id, row_number() OVER (ORDER BY life_impact DESC, last_activity_at DESC, event_id) AS rank FROM p WHERE life_impact IS NOT NULL), b AS (
      SELECT 'corroborated' AS section, event_id, row_number() OVER (ORDER BY independent_sources DESC, confidence DESC NULLS LAST, event_id) AS rank FROM p WHERE independent_sources >= 2)
    SELECT section, rank, event_id FROM a WHERE rank <= 6 UNION ALL SELECT section, rank, event_id FROM b WHERE rank <= 6""",
)
def brief_sections(spark, d):
    return products.brief_sections(briefed(spark, d), now(), hours=2400).select("section", "rank", "event_id")


_FOLLOWS = """fo AS (SELECT c_custkey AS user_id, c_custkey % 3 AS k, CASE c_custkey % 3 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'economy' ELSE 'politics' END WHEN 1 THEN 'NATION_' || c_nationkey ELSE c_custkey::VARCHAR END AS target FROM customer)"""


@query(
    "personal_feed",
    f"""WITH {EV}, {_FOLLOWS}, m AS (
      SELECT user_id, event_id, last_activity_at FROM fo JOIN ev ON k = 0 AND target = category WHERE status = 'PUBLISHED' UNION
      SELECT user_id, event_id, last_activity_at FROM fo JOIN ev ON k = 1 AND target = country WHERE status = 'PUBLISHED' UNION
      SELECT user_id, event_id, last_activity_at FROM fo JOIN ev ON k = 2 AND target = event_id::VARCHAR WHERE status = 'PUBLISHED')
    SELECT user_id, rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_activity_at DESC, event_id) AS rank FROM m) WHERE rank <= 40""",
)
def personal_feed(spark, d):
    return products.personal_feed(T.events(spark, d), T.follows(spark, d))


@query("bookmarked", f"WITH {EV} SELECT owner_id AS user_id, event_id FROM ev WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY last_activity_at DESC, event_id) <= 3")
def bookmarked(spark, d):
    e = T.events(spark, d)
    marks = e.filter("event_id % 3 = 0").select(F.col("owner_id").alias("user_id"), "event_id", F.col("last_activity_at").alias("bookmarked_at"))
    return J.bookmarked(marks, e, 3).select("user_id", "event_id")


@query("inbox", f"WITH {EV} SELECT owner_id AS user_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY published_at DESC, event_id) <= 5")
def inbox(spark, d):
    e = T.events(spark, d)
    n = e.select(F.col("owner_id").alias("user_id"), F.lit(1).alias("rule_id"), "event_id", F.col("published_at").alias("created_at"))
    return J.inbox(n, e.select("event_id", "title"), 5).select("user_id", "event_id")


@query("unread_counts", f"WITH {EV} SELECT owner_id AS user_id, count(*) FILTER (event_id % 4 = 0) AS unread FROM ev GROUP BY owner_id")
def unread_counts(spark, d):
    n = T.events(spark, d).select(F.col("owner_id").alias("user_id"), F.when(F.col("event_id") % 4 != 0, F.col("published_at")).alias("read_at"))
    return A.unread_counts(n)


@query("search_titles", f"WITH {EV} SELECT event_id FROM ev WHERE contains(lower(title), '77 by') ORDER BY last_activity_at DESC, event_id LIMIT 40")
def search_titles(spark, d):
    return R.search_substring(T.events(spark, d), " 77 BY ", fields=("title",)).select("event_id")


def _graph_events(spark, d):
    e, k = T.events(spark, d), F.col("event_id")
    exact = k % 3 == 1
    return e.filter("status = 'PUBLISHED'").select(
        k.alias("id"), "title", "category", "country", F.when(k % 4 == 0, F.concat(F.lit("place "), (F.col("owner_id") % 40).cast("string"))).alias("place"),
        F.when(exact, ((F.col("owner_id") * 37) % 181 - 90).cast("double")).alias("lat"), F.when(exact, ((F.col("owner_id") * 101) % 361 - 180).cast("double")).alias("lon"),
        F.when(exact, "exact").when(k % 5 == 0, "unknown").otherwise("approximate").alias("geo_precision"), "last_activity_at",
    )


_GE = f"""{EV}, ge AS (SELECT event_id AS id, category, country, CASE WHEN event_id % 4 = 0 THEN 'place ' || owner_id % 40 END AS place, CASE WHEN event_id % 3 = 1 THEN 'exact' WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'approximate' END AS geo,
    CASE WHEN event_id % 3 = 1 THEN radians((owner_id * 37) % 181 - 90) END AS lat, CASE WHEN event_id % 3 = 1 THEN radians((owner_id * 101) % 361 - 180) END AS lon, last_activity_at AS at FROM ev WHERE status = 'PUBLISHED'),
  pr AS (SELECT a.id AS from_id, b.id AS to_id, a.category AS ac, b.category AS bc, a.place AS ap, b.place AS bp, abs(date_diff('hour', a.at, b.at)) AS h, a.geo = 'exact' AND b.geo = 'exact' AS both_exact,
    a.country = b.country AND a.geo <> 'unknown' AND b.geo <> 'unknown' AS near_,
    12742.0 * asin(least(1.0, sqrt(pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2)))) AS km
  FROM ge a JOIN ge b ON a.id < b.id AND b.at BETWEEN a.at - INTERVAL 168 HOUR AND a.at + INTERVAL 168 HOUR)"""
_SAME_LOCATION = """SELECT from_id, to_id, CASE WHEN both_exact THEN CAST(floor(greatest(40.0, 95 - km / 300 * 55) + 0.5) AS BIGINT) ELSE 45 END AS strength FROM pr
  WHERE (both_exact AND km < 300) OR (NOT both_exact AND near_ AND ap = bp)"""
_TEMPORAL = "SELECT from_id, to_id, CAST(floor(greatest(35.0, 75.0 - h) + 0.5) AS BIGINT) AS strength FROM pr WHERE ac = bc AND h > 0 AND h <= 72 AND (near_ OR (both_exact AND km < 500))"
_CROSS = "SELECT from_id, to_id, CAST(floor(greatest(30.0, 65.0 - h / 2.0) + 0.5) AS BIGINT) AS strength FROM pr JOIN lk ON ac = x AND bc = y WHERE near_ AND h <= 48"


@query("edges_same_location", f"WITH {_GE} {_SAME_LOCATION}")
def edges_same_location(spark, d):
    return graph.same_location(_graph_events(spark, d)).select("from_id", "to_id", "strength")


@query("edges_temporal", f"WITH {_GE} {_TEMPORAL}")
def edges_temporal(spark, d):
    return graph.temporal_sequence(_graph_events(spark, d)).select("from_id", "to_id", "strength")


@query("event_pairs", f"WITH {_GE} SELECT ac AS category, count(*) AS pairs, max(h)::BIGINT AS most_hours FROM pr WHERE ac = bc GROUP BY ac")
def event_pairs(spark, d):
    pairs = graph.pair_counts(_graph_events(spark, d), ["category"])
    return pairs.groupBy("category").agg(F.sum("n").alias("pairs"), F.max("h").cast("long").alias("most_hours"))


_LINKED = ", ".join(f"('{x}', '{y}'), ('{y}', '{x}')" for x, y in graph.LINKED_DOMAINS)


@query("edges_cross_domain", f"WITH {_GE}, lk(x, y) AS (VALUES {_LINKED}) {_CROSS}")
def edges_cross_domain(spark, d):
    return graph.cross_domain(_graph_events(spark, d)).select("from_id", "to_id", "strength")


_EDGES = f"""{_GE}, lk(x, y) AS (VALUES {_LINKED}), eg AS (
  SELECT 'same_location' AS kind, * FROM ({_SAME_LOCATION}) UNION ALL SELECT 'temporal_sequence', * FROM ({_TEMPORAL}) UNION ALL SELECT 'cross_domain_impact', * FROM ({_CROSS}))"""


@query("edge_stats", f"WITH {_EDGES} SELECT kind, count(*) AS n, CAST(floor(avg(strength) + 0.5) AS BIGINT) AS mean_strength FROM eg GROUP BY kind")
def edge_stats(spark, d):
    return A.edge_stats(graph.edge_counts(_graph_events(spark, d)))


@query(
    "related_top8",
    f"""WITH {_EDGES}, both_ AS (SELECT from_id AS event_id, to_id AS other_id, kind, strength FROM eg UNION ALL SELECT to_id, from_id, kind, strength FROM eg)
    SELECT b.event_id, other_id, kind, strength::BIGINT AS strength FROM both_ b JOIN ev ON ev.event_id = other_id AND status = 'PUBLISHED'
    QUALIFY row_number() OVER (PARTITION BY b.event_id ORDER BY strength DESC, last_activity_at DESC, other_id, kind) <= 8""",
)
def related_top8(spark, d):
    return graph.related(saved(_graph_events(spark, d).drop("title")))


@query(
    "places_near",
    """WITH p AS (SELECT s_suppkey AS id, radians((s_suppkey * 37) % 181 - 90) AS lat, radians((s_suppkey * 101) % 361 - 180) AS lon FROM supplier)
    SELECT a.id AS a_id, b.id AS b_id FROM p a JOIN p b ON a.id < b.id
    AND 12742.0 * asin(least(1.0, sqrt(pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2)))) < 500""",
)
def places_near(spark, d):
    p = T.places(spark, d)
    return J.radius_join(p, p, 500).filter("a_id < b_id").select("a_id", "b_id")


@query(
    "source_health",
    """WITH a AS (SELECT user_id AS source_id, ts AS tm, event_id AS id, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) % 4 AS items FROM events),
    i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source_id ORDER BY tm, id) AS island FROM a), c AS (SELECT * FROM i QUALIFY island = max(island) OVER (PARTITION BY source_id))
    SELECT source_id, CASE WHEN NOT arg_max(ok, id) THEN 'offline' WHEN arg_max(items, id) = 0 THEN 'degraded' ELSE 'online' END AS status, count(*) FILTER (NOT ok) AS consecutive_fails FROM c GROUP BY source_id""",
)
def source_health(spark, d):
    e = T.read(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), (F.floor("value") % 4).alias("items"), F.lit(0).alias("parse_failures")
    )
    return feeds.source_health(e).select("source_id", "status", "consecutive_fails")


@query(
    "fold_follows",
    """WITH l AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target, ts, event_id, CASE event_type WHEN 'error' THEN 'remove' WHEN 'click' THEN 'toggle' ELSE 'add' END AS action FROM events),
    o AS (SELECT user_id, target, max(event_id) FILTER (action <> 'toggle') AS base FROM l GROUP BY ALL),
    f AS (SELECT o.user_id, o.target, bool_or(l.event_id = o.base AND action = 'add') AS started, count(*) FILTER (action = 'toggle' AND (base IS NULL OR l.event_id > base)) AS flips FROM o JOIN l USING (user_id, target) GROUP BY ALL)
    SELECT user_id, target FROM f WHERE coalesce(started, false) <> (flips % 2 = 1)""",
)
def fold_follows(spark, d):
    action = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "toggle").otherwise("add")
    log = T.read(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("target"), F.col("ts").alias("at"), F.col("event_id").alias("id"), action.alias("action"))
    return ledgers.fold_changes(log, ["user_id", "target"]).select("user_id", "target")


@query(
    "stale_events",
    f"WITH {EV} SELECT event_id FROM ev WHERE status <> 'PUBLISHED' AND date_diff('hour', last_activity_at, {NOW}) > 45 * 24 AND event_id % 7 <> 0 AND event_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 2) AND event_id % 9 <> 0",
)
def stale_events(spark, d):
    e = T.events(spark, d)
    f = T.follows(spark, d).filter("kind = 'event'").select(F.col("target").cast("long").alias("event_id"))
    return retention.stale_events(e, retention.Policy(), now(), e.filter("event_id % 7 = 0"), f, e.filter("event_id % 9 = 0")).select("event_id")


@query("payload_cap", "SELECT event_id AS article_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 2000 AS keep FROM events")
def payload_cap(spark, d):
    e = T.read(spark, d, "events").select(F.col("event_id").alias("article_id"), F.col("ts").alias("at"))
    return W.newest_overall(e, 2000, "at", "article_id").select("article_id", "keep")


@query(
    "run_retention",
    "SELECT event_id AS run_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND event_id NOT IN (SELECT max(event_id) FROM events GROUP BY user_id, event_type)",
)
def run_retention(spark, d):
    e = T.read(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("event_id"), F.col("event_type").alias("agent"), F.col("ts").alias("at"))
    return W.protect_latest(e, ["event_id", "agent"], "at", "run_id", F.col("at") < T.at("2024-01-20 00:00:00")).select("run_id")


@query(
    "audit_archive",
    """WITH c AS (SELECT event_type AS action, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type)
    SELECT sum(n)::BIGINT AS entries, string_agg(action || '=' || n, ', ' ORDER BY n DESC, action) AS actions FROM c""",
)
def audit_archive(spark, d):
    e = T.read(spark, d, "events").select(F.col("event_type").alias("action"), F.col("ts").alias("at"))
    return A.archive_audit(e, F.col("at") < T.at("2024-01-20 00:00:00")).select("entries", "actions")


@query(
    "retention_plan",
    """SELECT 'views' AS step, count(*) AS rows FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' UNION ALL
    SELECT 'runs', count(*) FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND event_id NOT IN (SELECT max(event_id) FROM events GROUP BY user_id, event_type)""",
)
def retention_plan(spark, d):
    e = T.read(spark, d, "events").withColumnRenamed("ts", "at")
    old = retention.older("at", 10, T.at(T.AS_OF_EVENTS))
    runs = W.protect_latest(e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("event_id"), F.col("event_type").alias("agent"), "at"), ["event_id", "agent"], "at", "run_id", old)
    return J.concat([e.filter(old).agg(F.lit("views").alias("step"), F.count("*").alias("rows")), runs.agg(F.lit("runs").alias("step"), F.count("*").alias("rows"))])


@query(
    "payload_bytes",
    "SELECT CASE WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-30 00:00:00') / 86400000000.0 < 7 THEN 'week' WHEN date_diff('microsecond', ts, TIMESTAMP '2024-01-30 00:00:00') / 86400000000.0 < 30 THEN 'month' ELSE 'older' END AS band, count(*) AS articles, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events GROUP BY 1",
)
def payload_bytes(spark, d):
    e = T.read(spark, d, "events").select(F.col("ts").alias("published_at"), F.col("props").alias("payload"))
    return A.payload_bytes(e, T.at(T.AS_OF_EVENTS))


@query("sitemap", f"WITH {EV} SELECT '<url><loc>https://n.example/event/' || event_id || '</loc><lastmod>' || strftime(last_activity_at, '%Y-%m-%d') || '</lastmod></url>' AS value FROM ev WHERE status = 'PUBLISHED' ORDER BY last_activity_at DESC, event_id LIMIT 5000")
def sitemap(spark, d):
    return products.sitemap_export(T.events(spark, d), "https://n.example")


@query(
    "top_by_articles",
    f"WITH {INPUTS} SELECT event_id, article_count FROM sv ORDER BY article_count DESC, event_id LIMIT 12",
)
def top_by_articles(spark, d):
    return W.top_by_articles(scored(spark, d)).select("event_id", "article_count")


@query("subject_export", "SELECT c_custkey AS user_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS bookmarks FROM customer")
def subject_export(spark, d):
    return _subject_export(spark, d, T.rules(spark, d))


def _subject_export(spark, d, who):
    e = T.events(spark, d).select(F.col("owner_id").alias("user_id"), "event_id")
    out = ledgers.subject_export(who.select("user_id"), {"bookmarks": e})
    return out.select("user_id", F.json_array_length("bookmarks").cast("long").alias("bookmarks"))


_LOG = "s AS (SELECT user_id, event_id AS id, epoch_us(ts) AS m, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(
    "rate_limited",
    f"""WITH RECURSIVE {_LOG}, w AS (SELECT user_id, id, n, m AS start, 1 AS c FROM s WHERE n = 1 UNION ALL
      SELECT s.user_id, s.id, s.n, CASE WHEN s.m - start >= 86400000000 THEN s.m ELSE start END, CASE WHEN s.m - start >= 86400000000 THEN 1 ELSE c + 1 END FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1)
    SELECT user_id, id FROM w WHERE c > 5""",
)
def rate_limited(spark, d):
    e = T.read(spark, d, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return ledgers.rate_limited(e, 5, 86_400, ["user_id"]).select("user_id", "id")


@query(
    "lockouts",
    f"""WITH RECURSIVE {_LOG}, w AS (SELECT user_id, id, n, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0::BIGINT AS until, false AS hit FROM s WHERE n = 1 UNION ALL
      SELECT s.user_id, s.id, s.n, CASE WHEN s.m < until THEN fails WHEN ok OR fails + 1 >= 5 THEN 0 ELSE fails + 1 END, CASE WHEN s.m < until THEN until WHEN ok OR fails + 1 < 5 THEN 0 ELSE s.m + 86400000000 END, s.m < until
      FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1)
    SELECT user_id, id FROM w WHERE hit""",
)
def lockouts(spark, d):
    e = T.read(spark, d, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("ok"))
    return limits.walk_lockouts(e, 5, 86_400).select("user_id", "id")


@query("views_windowed", "SELECT epoch_us(time_bucket(INTERVAL 24 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def views_windowed(spark, d):
    e = T.read(spark, d, "events")
    return cycle.windowed(e, "ts", "24 hours", ["event_type"]).select(F.unix_micros("start").alias("start_us"), "event_type", "n")
