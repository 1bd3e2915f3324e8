"""Queries over sources and ledgers, small predicates, event pages, retention as a whole, and clusters' candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import tables as T
from ..functions import measures as M
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import rows as R
from ..operators import windows as W
from ..plans import graph, products, retention, review
from ..saved import shared_dir
from ..sources import feeds, ledgers
from ..streaming import cycle
from . import query
from .events import _ADMIT, _FOLLOWS, AR, BRIEFED, EV, INPUTS, NOW, NOW_V, SC, SO, VW, _urls, admitted, briefed, now, scored
from .more import _measured
from .texts import TX, toks

# ---- sources and ledgers --------------------------------------------------------------------


@query("active_sources", "SELECT s_suppkey AS source_id FROM supplier WHERE s_suppkey % 6 <> 0 AND s_suppkey % 5 <> 0")
def active_sources(spark, d):
    k = F.col("source_id")
    return R.active_sources(T.sources(spark, d).withColumns({"enabled": k % 6 != 0, "blocked": k % 5 == 0})).select("source_id")


@query("upserted_sources", "SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS source_name, CASE WHEN s_suppkey % 3 = 0 THEN 'x' END AS note FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
def upserted_sources(spark, d):
    s = T.sources(spark, d).select("source_id", "source_name")
    new = s.filter("source_id % 3 = 0").select("source_id", F.concat(F.lit("new "), "source_name").alias("source_name"), F.lit("x").alias("note"))
    return feeds.upsert_sources(s.filter("source_id % 2 = 0"), new)


@query("ledger_days", "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS entries, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def ledger_days(spark, d):
    """A ledger that is appended to twice, read by its days."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    e = T.read(spark, d, "events").select("event_id", "event_type", F.col("ts").alias("at"))
    for part in (e.filter("event_type = 'error'"), e.filter("event_type <> 'error'")):
        ledgers.append_ledger(part, path)
    log = spark.read.parquet(path)
    return log.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("entries"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(
    "quakes",
    """SELECT s_suppkey::VARCHAR AS provider_event_id, 'M ' || s_suppkey % 9 AS title, 1704067200000000 + s_suppkey * 1000000 AS published_us, ((s_suppkey * 37) % 181 - 90)::DOUBLE AS lat, ((s_suppkey * 101) % 361 - 180)::DOUBLE AS lon,
      (s_suppkey % 9)::DOUBLE::VARCHAR AS magnitude, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 50)::DOUBLE::VARCHAR END AS depth_km, CASE WHEN s_suppkey % 2 = 0 THEN 'green' END AS alert FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def quakes(spark, d):
    """A quake feed a supplier, as the provider writes it; every fifth has no link and goes."""
    p = T.places(spark, d).withColumn("k", F.col("id"))
    k = F.col("k")
    properties = F.struct(
        F.concat(F.lit("M "), (k % 9).cast("string")).alias("title"), F.when(k % 5 != 0, F.concat(F.lit("https://q.example/"), k.cast("string"))).alias("url"), (F.lit(1704067200000) + k * 1000).alias("time"),
        (k % 9).cast("double").alias("mag"), F.when(k % 2 == 0, "green").alias("alert"),
    )
    where = F.struct(F.concat(F.array("lon", "lat"), F.when(k % 4 == 0, F.array((k % 50).cast("double"))).otherwise(F.array().cast("array<double>"))).alias("coordinates"))
    body = F.to_json(F.struct(F.array(F.struct(k.cast("string").alias("id"), properties.alias("properties"), where.alias("geometry"))).alias("features")))
    q = feeds.parse_quake_geojson(p.select(body.alias("body")))
    get = lambda name: F.try_element_at("measurements", F.lit(name)).alias(name)
    return q.select("provider_event_id", "title", F.unix_micros("published_at").alias("published_us"), "lat", "lon", get("magnitude"), get("depth_km"), get("alert"))


@query("cycle_report", "SELECT '{\"events\":' || (SELECT count(*) FROM orders) || ',\"articles\":' || (SELECT count(*) FROM lineitem) || ',\"held\":[' || string_agg('{\"reason\":\"' || reason || '\",\"n\":' || n || '}', ',' ORDER BY reason) || ']}' AS report FROM (SELECT o_orderstatus AS reason, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)")
def cycle_report(spark, d):
    o = T.read(spark, d, "orders")
    return products.cycle_report({"events": o, "articles": T.read(spark, d, "lineitem")}, o.filter("o_orderstatus <> 'F'").select(F.col("o_orderstatus").alias("reason")))


@query("jobs_due", f"SELECT event_type AS job, date_diff('microsecond', max(ts), {NOW_V}) / 3600000000.0 >= 6 AS due FROM events GROUP BY 1 UNION ALL SELECT 'never', true")
def jobs_due(spark, d):
    control = T.read(spark, d, "events").select(F.col("event_type").alias("job"), F.col("ts").alias("last_run"))
    names = ["click", "error", "purchase", "signup", "view", "never"]
    each = J.concat([cycle.due(control, n, T.at(T.AS_OF_EVENTS), 6).select(F.lit(n).alias("job"), "due", F.lit(n == "never").alias("_x")) for n in names])
    known = control.select("job").distinct()
    return each.join(known, "job", "left_semi").unionByName(each.filter("_x")).select("job", "due")


# ---- predicates and joins -------------------------------------------------------------------


@query("pending_articles", f"WITH {TX} SELECT article_id FROM tx WHERE article_id % 2 = 0 AND article_id % 10 <> 4 ORDER BY published_at, article_id LIMIT 500")
def pending_articles(spark, d):
    k = F.col("article_id")
    a = T.text_articles(spark, d).withColumns({"event_id": F.when(k % 2 == 1, k), "is_test": k % 10 == 4, "ingested_at": F.col("published_at")})
    return R.pending_articles(a.withColumn("published_at", F.when(k % 3 != 0, F.col("published_at")))).select("article_id")


@query("events_in_lists", f"WITH {EV} SELECT category, country, count(*) AS n FROM ev WHERE category IN ('economy', 'politics') AND country IN ('NATION_1', 'NATION_7') GROUP BY ALL")
def events_in_lists(spark, d):
    e = T.events(spark, d).filter(R.in_list("category", ["economy", "politics"]) & R.in_list("country", ["NATION_1", "NATION_7"]))
    return e.groupBy("category", "country").agg(F.count("*").alias("n"))


@query("category_labels", f"WITH {EV} SELECT CASE category WHEN 'war_conflict' THEN 'War and conflict' WHEN 'natural_events' THEN 'Natural events' WHEN 'economy' THEN 'Economy' WHEN 'politics' THEN 'Politics' ELSE 'Unclassified' END AS label, count(*) AS n, max('/event/' || event_id) AS url FROM ev GROUP BY 1")
def category_labels(spark, d):
    return R.decorate(T.events(spark, d), now()).groupBy("label").agg(F.count("*").alias("n"), F.max("url").alias("url"))


@query("article_sources", f"WITH {AR}, {SO} SELECT event_id, line::BIGINT AS line, part, source_name, reliability_score FROM ar JOIN so USING (source_id)")
def article_sources(spark, d):
    return J.with_source(T.articles(spark, d), T.sources(spark, d)).select("event_id", "line", "part", "source_name", "reliability_score")


@query(
    "events_with_scores",
    f"""WITH {EV}, {SC}, l AS (SELECT event_id, CASE kind WHEN 'click' THEN 'confidence' WHEN 'view' THEN 'relevance' ELSE 'trending' END AS kind, value, computed_at, id FROM sc),
    t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY computed_at DESC, id DESC) = 1)
    SELECT ev.event_id, max(value) FILTER (kind = 'confidence') AS confidence, max(value) FILTER (kind = 'relevance') AS relevance, max(value) FILTER (kind = 'trending') AS trending FROM ev LEFT JOIN t USING (event_id) GROUP BY ev.event_id""",
)
def events_with_scores(spark, d):
    kind = F.when(F.col("kind") == "click", "confidence").when(F.col("kind") == "view", "relevance").otherwise("trending")
    return J.with_scores(T.events(spark, d), T.scores(spark, d).withColumn("kind", kind)).select("event_id", "confidence", "relevance", "trending")


@query("events_with_first_line", f"WITH {EV}, {AR} SELECT event_id FROM ev SEMI JOIN (SELECT event_id FROM ar WHERE line = 1 AND part % 10 = 0) USING (event_id)")
def events_with_first_line(spark, d):
    return J.having_match(T.events(spark, d), T.articles(spark, d), (F.col("line") == 1) & (F.col("part") % 10 == 0)).select("event_id")


@query(
    "passage_candidates",
    f"""WITH {TX}, b AS (SELECT item_id, TIMESTAMP '2024-01-03 12:00:00' AS at, unnest({toks('text')}) AS token FROM benchmark), e AS (SELECT article_id AS event_id, published_at AS at, unnest({toks('title')}) AS token FROM tx)
    SELECT item_id AS article_id, event_id, count(*) AS shared FROM b JOIN e USING (token) WHERE e.at > b.at - INTERVAL 48 HOUR GROUP BY ALL""",
)
def passage_candidates(spark, d):
    """Events, one a document, that a benchmark passage may join as an unclassified article."""
    b = T.read(spark, d, "benchmark").select(F.col("item_id").alias("article_id"), F.lit("unclassified").alias("category"), T.at("2024-01-03 12:00:00").alias("published_at"), F.lit(None).cast("string").alias("title"), F.col("text").alias("summary"))
    e = T.text_articles(spark, d).select("event_id", F.col("lang").alias("category"), F.col("published_at").alias("last_activity_at"), "title")
    return J.candidates(b, e)


@query("articles_with_measurement", "SELECT l_orderkey AS event_id, l_linenumber::BIGINT AS line, count(*) FILTER (l_partkey % 2 = 0 OR l_partkey % 5 = 0) AS measured FROM lineitem GROUP BY ALL")
def articles_with_measurement(spark, d):
    m = _measured(spark, d).select("event_id", F.col("article_id.line").alias("line"), A.has_measurement("measurements").alias("has"))
    return m.groupBy("event_id", "line").agg(F.count_if("has").alias("measured"))


@query("stated_measures", "SELECT l_orderkey AS event_id, 'depth_km' AS measure, l_partkey::VARCHAR AS value FROM lineitem WHERE l_partkey % 2 = 0 UNION ALL SELECT l_orderkey, 'magnitude', (l_partkey % 9)::VARCHAR FROM lineitem WHERE l_partkey % 5 = 0")
def stated_measures(spark, d):
    return R.explode_measurements(_measured(spark, d))


@query("shared_title_words", f"WITH {TX}, t AS (SELECT article_id, {toks('title')} AS k FROM tx) SELECT a.article_id, array_to_string(list_sort(list_intersect(a.k, b.k)), ' ') AS words FROM t a JOIN t b ON b.article_id = a.article_id + 1")
def shared_title_words(spark, d):
    t = T.text_articles(spark, d).select("article_id", X.tokens(F.col("title")).alias("k"))
    after = t.select((F.col("article_id") - 1).alias("article_id"), F.col("k").alias("next"))
    return t.join(after, "article_id").select("article_id", F.array_join(F.array_sort(J.shared(F.col("k"), F.col("next"))), " ").alias("words"))


@query("log_fields", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def log_fields(spark, d):
    return T.read(spark, d, "events").groupBy(X.json_field(F.col("props"), "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("bot_clients", "SELECT c_custkey AS client, c_custkey % 6 NOT IN (1, 2) AS bot FROM customer")
def bot_clients(spark, d):
    k = F.col("c_custkey") % 6
    agent = F.when(k == 0, "Searchbot/2.1").when(k == 1, "Mozilla/5.0 (X11)").when(k == 2, "Opera/9").when(k == 3, "CURL/8.1").when(k == 4, "")
    return T.read(spark, d, "customer").select(F.col("c_custkey").alias("client"), X.is_bot(agent).alias("bot"))


@query("clamped_times", "SELECT o_orderkey AS event_id, epoch_us(least(o_orderdate, TIMESTAMP '1998-01-01')) AS at_us FROM orders")
def clamped_times(spark, d):
    return T.events(spark, d).select("event_id", F.unix_micros(M.clamp_future(F.col("last_activity_at"), T.at("1998-01-01 00:00:00"))).alias("at_us"))


@query("new_notifications", "SELECT DISTINCT o_custkey AS user_id, o_custkey % 3 AS rule_id, o_orderkey // 4 AS event_id FROM orders WHERE NOT (o_orderkey // 4 % 5 = 0 AND o_custkey % 3 = 1)")
def new_notifications(spark, d):
    o = T.read(spark, d, "orders")
    m = o.select(F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 3).alias("rule_id"), F.expr("o_orderkey div 4").alias("event_id"))
    return cycle.notify_once(m, m.filter("event_id % 5 = 0 and rule_id = 1"))


@query("recent_log", "SELECT event_id AS id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_log(spark, d):
    return W.recent(T.read(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at")), 200).select("id", "user_id")


_LINKS = ", ".join(f"('{x}', '{y}'), ('{y}', '{x}')" for x, y in graph.LINKED_DOMAINS)


@query("linked_domains", f"WITH {EV}, lk(x, y) AS (VALUES {_LINKS}) SELECT a.category AS first, b.category AS second, bool_or(x IS NOT NULL) AS linked, count(*) AS n FROM ev a JOIN ev b ON b.event_id = a.event_id + 1 LEFT JOIN lk ON x = a.category AND y = b.category GROUP BY ALL")
def linked_domains(spark, d):
    e = T.events(spark, d).select("event_id", F.col("category").alias("first"))
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("first").alias("second"))
    return e.join(after, "event_id").groupBy("first", "second").agg(F.bool_or(graph.linked_domains(F.col("first"), F.col("second"))).alias("linked"), F.count("*").alias("n"))


# ---- review ---------------------------------------------------------------------------------


def _supervised(spark, d):
    e = scored(spark, d).drop("article_count")
    titled = _urls(spark, d).join(e.select("event_id", "title"), "event_id")
    return review.supervise(e, titled, conflicts=e.filter("conflicts > 0"))


_CHECKED = f"{INPUTS}, af AS (SELECT event_id, count(*) AS n, bool_and(part % 97 <> 0) AS urls FROM ar GROUP BY event_id), q AS (SELECT sv.*, coalesce(n, 0) AS n, coalesce(urls, false) AS urls FROM sv LEFT JOIN af USING (event_id))"


@query(
    "review_findings",
    f"""WITH {_CHECKED}, c AS (SELECT unnest(['has_articles', 'urls', 'confidence_known', 'confidence_enough', 'impact_is_backed', 'no_conflicts']) AS "check", unnest(['blocking', 'blocking', 'review', 'review', 'review', 'review']) AS severity,
      unnest([n > 0, urls, confidence IS NOT NULL, coalesce(confidence, 0) >= 30, NOT (coalesce(life_impact, 0) >= 80 AND coalesce(confidence, 0) < 70), conflicts = 0]) AS ok FROM q)
    SELECT "check", severity, count(*) FILTER (NOT ok) AS failed FROM c GROUP BY ALL""",
)
def review_findings(spark, d):
    f = R.explode_findings(_supervised(spark, d)).filter(~F.col("check").isin("title_traceable", "timestamps", "no_failures"))
    return f.groupBy("check", "severity").agg(F.count_if(~F.col("ok")).alias("failed"))


@query(
    "queued_reviews",
    f"""WITH {_CHECKED}, r AS (SELECT *, CASE WHEN n = 0 OR NOT urls THEN 'BLOCK' WHEN confidence IS NULL OR confidence < 30 OR (coalesce(life_impact, 0) >= 80 AND confidence < 70) OR conflicts > 0 THEN 'REVIEW_REQUIRED' ELSE 'APPROVE' END AS decision FROM q)
    SELECT event_id, CASE WHEN decision = 'BLOCK' THEN 90 ELSE 50 END::BIGINT AS priority FROM r WHERE (decision <> 'APPROVE' OR category = 'unclassified') AND event_id % 6 <> 0""",
)
def queued_reviews(spark, d):
    """Events that the gate holds; every sixth has an open item already."""
    open_ = T.events(spark, d).select("event_id", F.when(F.col("event_id") % 6 == 0, "open").otherwise("closed").alias("state"))
    return review.to_queue(review.quality_gate(_supervised(spark, d)), open_).select("event_id", "priority")


@query("published_without_article", f"WITH {EV}, {AR} SELECT event_id FROM ev WHERE status = 'PUBLISHED' AND event_id NOT IN (SELECT event_id FROM ar WHERE part % 97 <> 0 AND line = 1)")
def published_without_article(spark, d):
    return review.invariant_published_has_article(T.events(spark, d), _urls(spark, d).filter("line = 1")).select("event_id")


# ---- event pages, inputs and retention as a whole -------------------------------------------


@query(
    "event_pages",
    f"""WITH {EV}, {AR}, {SO}, {SC}, p AS (SELECT event_id FROM ev WHERE status = 'PUBLISHED'),
      art AS (SELECT event_id, source_id * 10 + line AS id, published_at FROM ar), a AS (SELECT event_id, string_agg(id, ',' ORDER BY published_at NULLS LAST, id) AS articles, string_agg(id, ',' ORDER BY published_at + INTERVAL 1 DAY * (id % 3), id) AS timeline FROM art GROUP BY 1),
      c AS (SELECT event_id, string_agg(line, ',' ORDER BY line) AS conflicts FROM (SELECT DISTINCT event_id, line FROM ar WHERE part % 5 = 0 AND line % 3 <> 0) GROUP BY 1),
      sl AS (SELECT event_id, kind, id FROM sc QUALIFY row_number() OVER (PARTITION BY event_id, kind ORDER BY computed_at DESC, id DESC) = 1), s AS (SELECT event_id, string_agg(id, ',' ORDER BY kind) AS scores FROM sl GROUP BY 1),
      ch AS (SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY computed_at DESC, id DESC) AS no FROM (SELECT *, lag(value) OVER w AS old, row_number() OVER w AS k FROM sc WINDOW w AS (PARTITION BY event_id, kind ORDER BY computed_at, id)) WHERE k = 1 OR value IS DISTINCT FROM old),
      ru AS (SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY computed_at DESC, id DESC) AS no FROM sc),
      st AS (SELECT user_id AS event_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS no FROM events),
      g AS (SELECT event_id - k AS event_id, event_id AS id, row_number() OVER (PARTITION BY event_id - k ORDER BY event_id * 13 % 90 DESC, event_id) AS no FROM ev, range(1, 11) r(k)),
      ag AS (SELECT event_id, string_agg(publisher_group, ',' ORDER BY publisher_group) AS source_agreement FROM (SELECT DISTINCT event_id, publisher_group FROM ar JOIN so USING (source_id)) GROUP BY 1)
    SELECT p.event_id, {", ".join(f"coalesce({c}, '') AS {c}" for c in ("articles", "timeline", "conflicts", "scores", "score_changes", "agent_runs", "supervisor", "state_history", "related", "source_agreement"))}
    FROM p LEFT JOIN a USING (event_id) LEFT JOIN c USING (event_id) LEFT JOIN s USING (event_id)
    LEFT JOIN (SELECT event_id, string_agg(id, ',' ORDER BY no) AS score_changes FROM ch WHERE no <= 10 GROUP BY 1) USING (event_id)
    LEFT JOIN (SELECT event_id, string_agg(id, ',' ORDER BY no) AS agent_runs FROM ru WHERE no <= 20 GROUP BY 1) USING (event_id)
    LEFT JOIN (SELECT event_id, string_agg(id, ',' ORDER BY no) AS supervisor FROM ru WHERE no <= 1 GROUP BY 1) USING (event_id)
    LEFT JOIN (SELECT event_id, string_agg(id, ',' ORDER BY no) AS state_history FROM st WHERE no <= 20 GROUP BY 1) USING (event_id)
    LEFT JOIN (SELECT event_id, string_agg(id, ',' ORDER BY no) AS related FROM g WHERE no <= 8 GROUP BY 1) USING (event_id) LEFT JOIN ag USING (event_id)""",
)
def event_pages(spark, d):
    """Published events with the ten children of a page; scores stand for runs and reviews too, and made neighbours for edges."""
    a, s = T.articles(spark, d), T.scores(spark, d)
    rows = a.select("event_id", (F.col("source_id") * 10 + F.col("line")).alias("id"), "published_at")
    timeline = rows.select("event_id", "id", F.timestamp_micros(F.unix_micros("published_at") + F.col("id") % 3 * 86_400_000_000).alias("at"))
    conflicts = a.filter("part % 5 = 0").select("event_id", F.col("line").alias("id"), (F.col("line") % 3 == 0).alias("resolved")).distinct()
    changes = W.score_changes(s).select("event_id", "id", F.col("computed_at").alias("at"))
    edges = T.events(spark, d).select(F.col("event_id").alias("id"), (F.col("event_id") * 13 % 90).alias("strength"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k")).select((F.col("id") - F.col("k")).alias("event_id"), "id", "strength")
    groups = A.source_agreement(a, T.sources(spark, d)).select("event_id", F.explode(F.map_keys("groups")).alias("publisher_group")).withColumn("id", F.col("publisher_group"))
    children = products.page_children(
        rows, timeline, conflicts, W.latest(s, ["event_id", "kind"], "computed_at", "id"), changes, s.select("event_id", "id", F.col("computed_at").alias("started_at")), s.select("event_id", "id", F.col("computed_at").alias("at")),
        T.states(spark, d), edges, groups,
    )
    out = products.event_detail(R.published(T.events(spark, d)).select("event_id"), children)
    return out.select("event_id", *[F.array_join(F.expr(f"transform({k}, x -> cast(x.id as string))"), ",").alias(k) for k in children])


@query(
    "score_inputs_whole",
    f"""WITH {EV}, {AR}, {_ADMIT}, c AS (SELECT event_id, count(*) AS conflicts FROM ar WHERE part % 5 = 0 AND part % 2 = 0 GROUP BY 1), t AS (SELECT event_id, count(*) AS timeline_points FROM ar WHERE line <= 3 GROUP BY 1),
      v AS (SELECT event_id, count(*) FILTER (reason IS NULL AND tm <= {NOW_V} AND tm > {NOW_V} - INTERVAL 24 HOUR) AS views_24h, count(*) FILTER (reason IS NULL AND tm <= {NOW_V} - INTERVAL 24 HOUR AND tm > {NOW_V} - INTERVAL 48 HOUR) AS views_prev_24h FROM adm GROUP BY 1)
    SELECT ev.event_id, coalesce(conflicts, 0) AS conflicts, coalesce(timeline_points, 0) AS timeline_points, coalesce(views_24h, 0) AS views_24h, coalesce(views_prev_24h, 0) AS views_prev_24h FROM ev LEFT JOIN c USING (event_id) LEFT JOIN t USING (event_id) LEFT JOIN v USING (event_id)""",
)
def score_inputs_whole(spark, d):
    a = T.articles(spark, d)
    conflicts = a.filter("part % 5 = 0").select("event_id", (F.col("part") % 2 == 1).alias("resolved"))
    out = A.score_inputs(T.events(spark, d), a, T.sources(spark, d), T.at(T.AS_OF_EVENTS), conflicts, admitted(spark, d), a.filter("line <= 3").select("event_id"))
    return out.select("event_id", "conflicts", "timeline_points", "views_24h", "views_prev_24h")


_OLD = f"date_diff('microsecond', ts, {NOW_V}) / 3600000000.0 > 10 * 24"
_PAYLOADS = f"""pa AS (SELECT event_id AS article_id, user_id % 2 = 0 AND {_OLD} AS aged, ts, event_id % 11 = 0 AS archived FROM events),
  bl AS (SELECT article_id FROM pa WHERE NOT archived AND aged UNION ALL SELECT article_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, article_id DESC) AS no FROM pa WHERE NOT archived AND NOT aged) WHERE no > 300)"""


def _logged_articles(spark, d):
    k = F.col("event_id")
    return T.read(spark, d, "events").select(k.alias("article_id"), F.when(F.col("user_id") % 2 == 0, k).alias("event_id"), F.col("ts").alias("published_at"), F.when(k % 11 == 0, R.ARCHIVED).otherwise(F.col("props")).alias("payload"))


_POLICY = retention.Policy().with_(payload_days=10, run_days=10, audit_days=10, view_days=10, review_days=10, payloads=300)


@query("live_payloads", "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_id % 11 <> 0")
def live_payloads(spark, d):
    return R.unarchived_payloads(_logged_articles(spark, d)).agg(F.count("*").alias("n"), F.min("article_id").alias("first"))


@query("blanked_payloads", f"WITH {_PAYLOADS} SELECT article_id FROM bl")
def blanked_payloads(spark, d):
    return retention.blank_payloads(_logged_articles(spark, d), _POLICY, T.at(T.AS_OF_EVENTS)).filter("blank").select("article_id")


def _retained(spark, d, dry_run):
    e = T.read(spark, d, "events").withColumnRenamed("ts", "at")
    ev = T.events(spark, d)
    tables = {
        "article": _logged_articles(spark, d),
        "run": e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("event_id"), F.col("event_type").alias("agent"), "at"),
        "audit": e.select(F.col("event_type").alias("action"), "at", F.lit(None).cast("string").alias("detail")),
        "view": e.select("event_id", "at"),
        "event": ev,
        "edge": ev.select(F.col("event_id").alias("from_id"), (F.col("event_id") + 1).alias("to_id"), F.lit("k").alias("kind"), F.col("last_activity_at").alias("created_at")),
        "review": e.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("event_id"), F.col("at").alias("reviewed_at")),
        "queue": ev.filter("event_id % 7 = 0").select("event_id", F.lit("open").alias("state")),
        "follow": T.follows(spark, d),
        "bookmark": ev.filter("event_id % 9 = 0").select("event_id"),
    }
    return retention.retain(tables, T.at(T.AS_OF_EVENTS), _POLICY, dry_run)


_GONE_EVENTS = "ge AS (SELECT event_id FROM ev WHERE status <> 'PUBLISHED' AND event_id % 7 <> 0 AND event_id % 9 <> 0 AND event_id::VARCHAR NOT IN (SELECT target FROM fo WHERE k = 2))"
_GONE_EDGES = "gd AS (SELECT event_id FROM ev WHERE status <> 'PUBLISHED' AND event_id + 1 NOT IN (SELECT event_id FROM ev WHERE status = 'PUBLISHED'))"
_GONE_RUNS = f"gr AS (SELECT event_id FROM events WHERE {_OLD} AND event_id NOT IN (SELECT arg_max(event_id, (ts, event_id)) FROM events GROUP BY user_id, event_type))"
_GONE_REVIEWS = f"gv AS (SELECT event_id FROM events WHERE {_OLD} AND event_id NOT IN (SELECT arg_max(event_id, (ts, event_id)) FROM events GROUP BY user_id))"


@query(
    "retention_report",
    f"""WITH {EV}, {_FOLLOWS}, {_PAYLOADS}, {_GONE_EVENTS}, {_GONE_EDGES}, {_GONE_RUNS}, {_GONE_REVIEWS}
    SELECT 'payloads' AS step, count(*) AS rows FROM bl UNION ALL SELECT 'runs', count(*) FROM gr UNION ALL SELECT 'audit', count(*) FROM events WHERE {_OLD} UNION ALL SELECT 'views', count(*) FROM events WHERE {_OLD}
    UNION ALL SELECT 'events', count(*) FROM ge UNION ALL SELECT 'edges', count(*) FROM gd UNION ALL SELECT 'reviews', count(*) FROM gv""",
)
def retention_report(spark, d):
    """A dry run over all tables."""
    return _retained(spark, d, True)[0]


@query(
    "retained_tables",
    f"""WITH {EV}, {_FOLLOWS}, {_PAYLOADS}, {_GONE_EVENTS}, {_GONE_EDGES}, {_GONE_RUNS}, {_GONE_REVIEWS}, n AS (SELECT count(*) AS n FROM events), o AS (SELECT count(*) AS n FROM ev)
    SELECT 'article' AS name, n AS rows FROM n UNION ALL SELECT 'run', n - (SELECT count(*) FROM gr) FROM n UNION ALL SELECT 'audit', n - (SELECT count(*) FROM events WHERE {_OLD}) + CASE WHEN (SELECT count(*) FROM events WHERE {_OLD}) > 0 THEN 1 ELSE 0 END FROM n
    UNION ALL SELECT 'view', n - (SELECT count(*) FROM events WHERE {_OLD}) FROM n UNION ALL SELECT 'event', n - (SELECT count(*) FROM ge) FROM o UNION ALL SELECT 'edge', n - (SELECT count(*) FROM gd) FROM o UNION ALL SELECT 'review', n - (SELECT count(*) FROM gv) FROM n
    UNION ALL SELECT 'article, payload blank', (SELECT count(*) FROM pa WHERE archived) + (SELECT count(*) FROM bl) FROM n""",
)
def retained_tables(spark, d):
    """The tables as retention leaves them, by their rows."""
    after = _retained(spark, d, False)[1]
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, df in after.items()]
    blank = after["article"].filter(F.col("payload") == R.ARCHIVED).agg(F.lit("article, payload blank").alias("name"), F.count("*").alias("rows"))
    return J.concat([*counts, blank])


_FOLLOWED = """m AS (SELECT user_id, event_id, published_at FROM fo JOIN p ON k = 0 AND target = category UNION SELECT user_id, event_id, published_at FROM fo JOIN p ON k = 1 AND target = country UNION
  SELECT user_id, event_id, last_activity_at FROM fo JOIN p ON k = 2 AND target = event_id::VARCHAR)"""


@query(
    "brief_followed",
    f"""WITH {INPUTS}, {_FOLLOWS}, {BRIEFED}, {_FOLLOWED}
    SELECT user_id, rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_at DESC, event_id) AS rank FROM m) WHERE rank <= 8""",
)
def brief_followed(spark, d):
    """What followers see first in their brief."""
    return products.brief_sections(briefed(spark, d), now(), hours=2400, follows=T.follows(spark, d)).filter("section = 'followed'").select("user_id", "rank", "event_id")


@query(
    "brief_disputed",
    f"""WITH {INPUTS}, {BRIEFED}
    SELECT rank, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY published_at DESC, event_id) AS rank FROM p WHERE conflicts = 2 AND event_id % 4 <> 0) WHERE rank <= 5""",
)
def brief_disputed(spark, d):
    """Events with an open conflict; every fourth conflict is resolved."""
    e = briefed(spark, d)
    conflicts = e.filter("conflicts = 2").select("event_id", (F.col("event_id") % 4 == 0).alias("resolved"))
    return products.brief_sections(e, now(), hours=2400, conflicts=conflicts).filter("section = 'disputed'").select("rank", "event_id")
