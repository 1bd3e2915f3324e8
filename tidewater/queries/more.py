"""Queries over read models, ledgers and identity rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import rows as R
from ..operators import windows as W
from ..plans import annotators, enrich, graph, products, review, scoring
from ..sources import feeds, ledgers
from ..streaming import views as V
from . import query
from .events import _ADMIT, AR, BRIEFED, EV, INPUTS, NOW, SO, VW, admitted, briefed, now, scored

_VIEWED = f"""{INPUTS}, {_ADMIT}, vc AS (SELECT event_id, count(*) FILTER (reason IS NULL) AS views_total FROM adm GROUP BY event_id),
  ve AS (SELECT sv.*, coalesce(views_total, 0) AS views_total FROM sv LEFT JOIN vc USING (event_id))"""


def _viewed(spark, d):
    return J.with_views(scored(spark, d), admitted(spark, d), T.at(T.AS_OF_EVENTS))


@query("event_views", f"WITH {_VIEWED} SELECT event_id, views_total FROM ve")
def event_views(spark, d):
    return _viewed(spark, d).select("event_id", "views_total")


def _by_views(direction: str) -> None:
    @query("events_by_views" + ("_asc" if direction == "asc" else ""), f"WITH {_VIEWED} SELECT event_id, views_total FROM ve WHERE status = 'PUBLISHED' ORDER BY views_total {direction} NULLS LAST, last_activity_at DESC NULLS LAST, event_id LIMIT 30 OFFSET 5")
    def run(spark, d):
        return W.page(W.order_events(R.published(_viewed(spark, d)), "views", direction), 30, 5).select("event_id", "views_total")


_TREND = f"""{VW}, g AS (SELECT event_id, max(tm) AS last_activity_at, count(*) FILTER (NOT is_bot AND tm > TIMESTAMP '{T.AS_OF_EVENTS}' - INTERVAL 24 HOUR AND tm <= TIMESTAMP '{T.AS_OF_EVENTS}') AS v,
  count(*) FILTER (NOT is_bot AND tm > TIMESTAMP '{T.AS_OF_EVENTS}' - INTERVAL 48 HOUR AND tm <= TIMESTAMP '{T.AS_OF_EVENTS}' - INTERVAL 24 HOUR) AS p FROM vw GROUP BY event_id),
  tr AS (SELECT event_id, last_activity_at, CASE WHEN v > 0 THEN CAST(greatest(0, least(100, least(60, floor(log10(v + 1) * 30 + 0.5)) + least(25, floor(((CASE WHEN p > 0 THEN v / p::DOUBLE ELSE 2.0 END) - 1) * 20 + 0.5))
    + CASE WHEN age < 3 THEN 15 WHEN age < 12 THEN 8 ELSE 0 END)) AS BIGINT) END AS trending FROM (SELECT *, greatest(0, date_diff('microsecond', last_activity_at, TIMESTAMP '{T.AS_OF_EVENTS}') / 3600000000.0) AS age FROM g))"""


def _by_trending(direction: str) -> None:
    @query("events_by_trending" + ("_asc" if direction == "asc" else ""), f"WITH {_TREND} SELECT event_id, trending FROM tr ORDER BY trending {direction} NULLS LAST, last_activity_at DESC, event_id LIMIT 30")
    def run(spark, d):
        v = T.views(spark, d).withColumn("counted", ~F.col("is_bot"))
        as_of = T.at(T.AS_OF_EVENTS)
        g = W.growth(v, as_of).join(v.groupBy("event_id").agg(F.max("at").alias("last_activity_at")), "event_id")
        return W.page(W.order_events(g.withColumn("trending", scoring.trending(as_of)), "trending", direction)).select("event_id", "trending")


for _d in ("desc", "asc"):
    _by_views(_d)
    _by_trending(_d)


@query("map_points", f"WITH {EV} SELECT event_id, ((owner_id * 37) % 181 - 90)::DOUBLE AS lat FROM ev WHERE status = 'PUBLISHED' AND event_id % 3 = 0 ORDER BY last_activity_at DESC, event_id LIMIT 300")
def map_points(spark, d):
    here = F.col("event_id") % 3 == 0
    e = T.events(spark, d).withColumns({"lat": F.when(here, ((F.col("owner_id") * 37) % 181 - 90).cast("double")), "lon": F.when(here, F.lit(0.0))})
    return R.map_points(e).select("event_id", "lat")


@query("timeline", f"WITH {AR}, {SO} SELECT ar.event_id, ar.line::BIGINT AS line, ar.source_id, source_name FROM ar LEFT JOIN so USING (source_id)")
def timeline(spark, d):
    return _timeline(spark, d, T.articles(spark, d))


def _timeline(spark, d, a):
    a = a.withColumn("article_id", F.monotonically_increasing_id())
    entries = a.select("event_id", "line", "source_id", "article_id", F.col("published_at").alias("at"))
    return J.timeline_rows(entries, T.sources(spark, d).select("source_id", "source_name"), a.select("article_id", "part")).select("event_id", "line", "source_id", "source_name")


_HEALTH = """at_ AS (SELECT user_id AS source_id, ts AS tm, event_id AS id, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) % 4 AS items FROM events),
  he AS (SELECT source_id, CASE WHEN NOT arg_max(ok, id) THEN 'offline' WHEN arg_max(items, id) = 0 THEN 'degraded' ELSE 'online' END AS status FROM at_ GROUP BY source_id)"""


def _health(spark, d):
    e = T.read(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), (F.floor("value") % 4).alias("items"), F.lit(0).alias("parse_failures")
    )
    return feeds.source_health(e)


@query("source_status", f"WITH {_HEALTH} SELECT s_suppkey AS source_id, status FROM supplier LEFT JOIN he ON source_id = s_suppkey")
def source_status(spark, d):
    return J.with_health(T.sources(spark, d), _health(spark, d)).select("source_id", "status")


@query("health_tally", f"WITH {_HEALTH} SELECT count(*) FILTER (status = 'online') AS online, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'offline') AS offline FROM he")
def health_tally(spark, d):
    return A.health_tally(_health(spark, d))


@query(
    "provider_matches",
    """WITH a AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS s, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 200 END AS p, l_shipdate AS t FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_shipdate) = 1)
    SELECT id AS article_id, f AS first_article_id FROM (SELECT *, first_value(id) OVER (PARTITION BY s, p ORDER BY t, id) AS f FROM a WHERE p IS NOT NULL) WHERE id <> f""",
)
def provider_matches(spark, d):
    return _provider_matches(T.articles(spark, d), F.when(F.col("part") % 3 == 0, (F.col("part") % 200).cast("string")), F.asc("published_at"))


def _provider_matches(a, provider, *then):
    one = W.top_n(a, ["event_id", "line"], [F.asc("source_id"), F.asc("part"), *then], 1)
    payload = feeds.payload_envelope(F.lit("p"), F.lit("raw"), F.create_map(F.lit("provider_event_id"), provider))
    return J.provider_matches(one.select((F.col("event_id") * 8 + F.col("line")).alias("article_id"), "source_id", "published_at", payload.alias("payload")))


@query(
    "first_measurements",
    """WITH a AS (SELECT l_orderkey AS event_id, l_shipdate AS t, l_linenumber AS n, l_suppkey AS s, l_partkey AS p FROM lineitem), m AS (
      SELECT event_id, 'depth_km' AS measure, p::VARCHAR AS value, s, row_number() OVER (PARTITION BY event_id ORDER BY t, n, s, p) AS r FROM a WHERE p % 2 = 0 UNION ALL
      SELECT event_id, 'magnitude', (p % 9)::VARCHAR, s, row_number() OVER (PARTITION BY event_id ORDER BY t, n, s, p) FROM a WHERE p % 5 = 0)
    SELECT event_id, measure, value, s AS source_id FROM m WHERE r = 1""",
)
def first_measurements(spark, d):
    return A.first_measurements(_measured(spark, d)).select("event_id", "measure", "value", "source_id")


def _measured(spark, d):
    p = F.col("part")
    m = F.map_from_entries(F.array(F.struct(F.lit("depth_km").alias("key"), F.when(p % 2 == 0, p.cast("string")).alias("value")), F.struct(F.lit("magnitude").alias("key"), F.when(p % 5 == 0, (p % 9).cast("string")).alias("value"))))
    order = F.struct("line", "source_id", "part")
    return T.articles(spark, d).select("event_id", "published_at", order.alias("article_id"), "source_id", F.lit("https://n.example").alias("url"), m.alias("measurements"), F.when(p % 11 == 0, p.cast("double")).alias("lat"), F.when(p % 11 == 0, F.lit(1.0)).alias("lon"))


@query(
    "natural_event_facts",
    """WITH a AS (SELECT l_orderkey AS event_id, l_shipdate AS t, l_linenumber AS n, l_suppkey AS s, l_partkey AS p FROM lineitem)
    SELECT event_id, bool_or(p % 2 = 0)::INT::BIGINT + bool_or(p % 5 = 0)::INT::BIGINT AS measures, arg_min(p, (t, n, s, p)) FILTER (p % 11 = 0)::DOUBLE AS lat FROM a GROUP BY event_id HAVING bool_or(p % 2 = 0) OR bool_or(p % 5 = 0) OR bool_or(p % 11 = 0)""",
)
def natural_event_facts(spark, d):
    f = enrich.natural_event_facts(_measured(spark, d))
    return f.select("event_id", F.coalesce(F.size("measures"), F.lit(0)).alias("measures"), "lat")


@query(
    "review_resolution",
    f"""WITH {EV} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PUBLISHED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'ARCHIVED' ELSE status END AS status,
      (CASE event_id % 4 WHEN 0 THEN 'PUBLISHED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'ARCHIVED' ELSE status END) <> status AS changed FROM ev""",
)
def review_resolution(spark, d):
    e = T.events(spark, d)
    k = F.col("event_id") % 4
    decisions = e.filter(k < 3).select("event_id", F.when(k == 0, "approve").when(k == 1, "reject").otherwise("override").alias("decision"), F.when(k == 2, "ARCHIVED").alias("state"))
    after, history = review.review_resolution(e, decisions, now())
    return after.select("event_id", "status").join(history.select("event_id", F.lit(True).alias("changed")), "event_id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


@query("open_reviews", f"WITH {EV} SELECT event_id, title FROM ev WHERE status = 'SUPERVISOR_REVIEW' AND event_id % 2 = 0")
def open_reviews(spark, d):
    e = T.events(spark, d)
    q = e.filter("status = 'SUPERVISOR_REVIEW'").select("event_id", F.when(F.col("event_id") % 2 == 0, "open").otherwise("closed").alias("state"))
    return J.open_reviews(q, e.select("event_id", "title")).select("event_id", "title")


@query(
    "upserted_edges",
    """WITH e AS (SELECT least(o_orderkey, o_custkey) AS from_id, greatest(o_orderkey, o_custkey) AS to_id, o_orderkey % 50 AS s, o_orderkey % 2 AS r FROM orders WHERE o_orderkey <> o_custkey)
    SELECT from_id, to_id, arg_max(s, r * 1000 + s) AS strength FROM e GROUP BY ALL""",
)
def upserted_edges(spark, d):
    o = T.read(spark, d, "orders").filter("o_orderkey <> o_custkey").select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"), F.lit("k").alias("kind"), (F.col("o_orderkey") % 50).alias("strength"), F.lit("b").alias("basis"), (F.col("o_orderkey") % 2).alias("r"))
    return graph.upsert_edges(o.filter("r = 0").drop("r"), o.filter("r = 1").drop("r")).select("from_id", "to_id", "strength")


@query("conflict_ids", "SELECT DISTINCT 'CFL-' || substr(sha1(o_orderkey || '|magnitude'), 1, 12) AS conflict_id, o_orderkey AS event_id FROM orders WHERE o_orderkey % 5 <> 4")
def conflict_ids(spark, d):
    e = T.events(spark, d).select("event_id", F.lit("magnitude").alias("field"), F.array(F.lit("1"), F.lit("2")).alias("values"))
    old = e.filter("event_id % 5 = 0").select(X.conflict_id(F.col("event_id").cast("string"), F.col("field")).alias("conflict_id"), "event_id", "field", F.lit("[]").alias("detail"), F.lit(True).alias("resolved"))
    return ledgers.upsert_conflicts(old, e.filter("event_id % 5 < 4")).filter("not resolved").select("conflict_id", "event_id")


@query("new_articles", "SELECT min(page_id) AS page_id, 'ART-' || substr(sha1(url), 1, 16) AS article_id FROM pages GROUP BY url HAVING bool_and(page_id % 3 <> 0)")
def new_articles(spark, d):
    p = T.feed_bodies(spark, d).select("page_id", F.col("url").alias("link"), F.timestamp_seconds(F.col("page_id")).alias("published_at"))
    known = p.filter("page_id % 3 = 0").select(X.article_id(F.col("link")).alias("article_id"))
    return feeds.insert_new_articles(p, known).select("page_id", "article_id")


@query("session_hashes", "SELECT c_custkey AS user_id, substr(sha256('salt|2024-01-01|10.0.0.' || c_custkey % 256 || '|' || c_mktsegment), 1, 32) AS session FROM customer")
def session_hashes(spark, d):
    c = T.read(spark, d, "customer")
    ip = F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 256).cast("string"))
    return c.select(F.col("c_custkey").alias("user_id"), X.session_hash(F.lit("2024-01-01"), ip, F.col("c_mktsegment"), "salt").alias("session"))


@query(
    "daily_brief",
    f"""WITH {INPUTS}, {BRIEFED},
      a AS (SELECT event_id, row_number() OVER (ORDER BY life_impact DESC, last_activity_at DESC, event_id) AS r FROM p WHERE life_impact IS NOT NULL),
      b AS (SELECT event_id, row_number() OVER (ORDER BY independent_sources DESC, confidence DESC NULLS LAST, event_id) AS r FROM p WHERE independent_sources >= 2)
    SELECT (SELECT count(*) FROM a WHERE r <= 6) + (SELECT count(*) FROM b WHERE r <= 6) AS total, (SELECT event_id FROM a WHERE r = 1) AS first_event""",
)
def daily_brief(spark, d):
    b = products.daily_brief(briefed(spark, d), now(), hours=2400)
    return b.select("total", F.element_at(F.element_at("sections", 1)["items"], 1)["event_id"].alias("first_event"))


@query("views_cooldown", "SELECT event_id AS id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE, false) AS rejected FROM events")
def views_cooldown(spark, d):
    v = T.views(spark, d)
    return v.select("id", W.cooldown(v, ["session"], 30).alias("rejected"))


@query("view_reasons", f"WITH {_ADMIT} SELECT coalesce(reason, 'counted') AS outcome, count(*) AS n FROM adm GROUP BY 1")
def view_reasons(spark, d):
    return V.admit_views(T.views(spark, d), F.col("is_bot"), 5 * 1440, 5, 24).groupBy(F.coalesce("reason", F.lit("counted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "annotator_runs",
    f"WITH {INPUTS} SELECT event_id, 'verification' AS agent, 'ok' AS status, NULL::VARCHAR AS reason FROM sv WHERE article_count > 0 UNION ALL SELECT event_id, 'verification', 'unavailable', 'error' FROM sv WHERE article_count = 0 UNION ALL SELECT event_id, 'model', 'unavailable', 'not_configured' FROM sv WHERE category = 'war_conflict'",
)
def annotator_runs(spark, d):
    e, a, s = scored(spark, d), T.articles(spark, d), T.sources(spark, d)

    def check(rows):
        v = enrich.verify(a, s)
        return rows.select("event_id").join(v, "event_id").select("event_id", F.lit("ok").alias("status"), F.to_json(F.struct("verdict", "groups")).alias("output"), F.lit(None).cast("int").alias("confidence"))

    steps = [annotators.Annotator("verification", "1", F.lit(True), check), annotators.Annotator("model", "1", F.col("category") == "war_conflict", None)]
    return annotators.run_annotators(e, steps, now()).select("event_id", "agent", "status", "reason")


@query("edges_with_titles", f"WITH {EV} SELECT a.event_id AS from_id, b.event_id AS to_id, a.event_id % 97 AS strength, b.title AS to_title FROM ev a JOIN ev b ON b.event_id = a.event_id + 1 ORDER BY strength DESC, from_id, to_id LIMIT 8")
def edges_with_titles(spark, d):
    e = T.events(spark, d)
    edges = e.select(F.col("event_id").alias("from_id"), (F.col("event_id") + 1).alias("to_id"), F.lit("k").alias("kind"), (F.col("event_id") % 97).alias("strength"))
    return J.edges_with_titles(edges, e).select("from_id", "to_id", "strength", "to_title")
