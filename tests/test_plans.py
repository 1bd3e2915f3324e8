"""Plans on small frames: the cases that went wrong once, and orders of decision."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates as A
from tidewater.operators import joins as J
from tidewater.operators import rows as R
from tidewater.operators import windows as W
from tidewater.plans import cluster, enrich, graph, products, retention, review, scoring
from tidewater.sources import feeds, ledgers

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def test_null_scores(spark):
    e = spark.createDataFrame([(1, None, at(0)), (2, 10, at(1)), (3, 90, at(2))], "event_id int, confidence int, last_activity_at timestamp")
    for direction, want in (("desc", [3, 2, 1]), ("asc", [2, 3, 1])):
        assert [r[0] for r in W.order_events(e, "confidence", direction).select("event_id").collect()] == want
    assert [r[0] for r in e.filter(R.score_at_least("confidence", 0)).select("event_id").collect()] == [2, 3]
    assert W.page(e, 500).count() == 3 and W.page(e, 1, 1).count() == 1


def test_latest_keeps_null(spark):
    s = spark.createDataFrame([(1, "a", 5, at(0), 1), (1, "a", None, at(1), 2)], "event_id int, kind string, value int, computed_at timestamp, id int")
    assert W.latest(s, ["event_id", "kind"], "computed_at", "id").first()["value"] is None
    assert W.score_changes(s).count() == 2


def test_confidence_unknown_without_reliability(spark):
    row = "event_id int, article_count int, independent_sources int, official_sources int, max_reliability int, avg_reliability double, countries int, conflicts int, timeline_points int, views_24h int, views_prev_24h int, category string, last_activity_at timestamp"
    i = spark.createDataFrame([(1, 3, 2, 1, None, None, 1, 0, 3, 0, 0, "unclassified", at(0)), (2, 3, 2, 1, 90, 80.0, 1, 1, 3, 9, 3, "health", at(0))], row)
    got = {(r["event_id"], r["kind"]): r for r in scoring.score_events(i, F.lit(at(2))).collect()}
    assert len(got) == 12
    assert got[1, "confidence"]["value"] is None and got[1, "life_impact"]["value"] is None and got[1, "trending"]["value"] is None
    assert got[2, "confidence"]["value"] == 24 + 25 + 18 + 10 - 15
    assert got[2, "trending"]["value"] == 30 + 25 + 15 and all(r["factors"] for r in got.values())
    frozen = scoring.score_events(i, F.lit(at(2)), frozen=True).filter("kind = 'trending'")
    assert [r["value"] for r in frozen.collect()] == [None, None]


def test_classify(spark):
    rules = spark.createDataFrame([("space", "esa", 3, 0), ("health", "flu", 3, 1), ("health", "new virus", 3, 2)], "category string, term string, weight int, ordinal int")
    a = spark.createDataFrame([(1, "s1", "A mesa posta", None), (2, "s1", "ESA and flu", None), (3, "s2", "A new virus, a flu", "x"), (4, "s2", "nothing", None)], "article_id int, source_id string, title string, summary string")
    declared = spark.createDataFrame([("s2", "sports")], "source_id string, category string")
    got = {r["article_id"]: (r["category"], r["confidence"]) for r in enrich.classify(a, rules, declared).collect()}
    assert got == {1: ("unclassified", "low"), 2: ("space", "medium"), 3: ("health", "high"), 4: ("sports", "low")}


def test_geocode_prefers_cities(spark):
    g = spark.createDataFrame([("france", "FR", 46.6, 2.2, "country", 0), ("paris", "FR", 48.9, 2.4, "city", 1)], "name string, country string, lat double, lon double, kind string, ordinal int")
    a = spark.createDataFrame([(1, "s", "In France, Paris", None), (2, "s", "parish", None)], "article_id int, source_id string, title string, summary string")
    so = spark.createDataFrame([("s", "PT")], "source_id string, country string")
    got = {r["article_id"]: (r["country"], r["place"], r["precision"]) for r in enrich.geocode(a, g, so).collect()}
    assert got == {1: ("FR", "Paris", "approximate"), 2: ("PT", None, "unknown")}


ARTICLE = "article_id string, source_id string, title string, summary string, category string, published_at timestamp, lat double, lon double, geo_country string, payload string, content_hash string"


def sequential(rows, score):
    """The walk in time order: each row joins its best founder or founds."""
    heads, out = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        best = max(((score[r[0], h[0]], h[1], h[0]) for h in heads if (r[0], h[0]) in score), default=None)
        out[r[0]] = best[2] if best else r[0]
        if not best:
            heads.append(r)
    return out


def test_cluster_is_the_sequential_walk(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"word{i:02d}" for i in range(14)]
    rows = [(f"a{i:03d}", "s", " ".join(rng.sample(vocabulary, 4)), None, "x", at(i), None, None, None, "{}", f"h{i}") for i in range(60)]
    a = spark.createDataFrame(rows, ARTICLE)
    score = {(r["later"], r["earlier"]): r["score"] for r in cluster.similar_pairs(a).collect()}
    got = {r["article_id"]: r["event_article_id"] for r in cluster.cluster(a).collect()}
    assert got == sequential([(r[0], r[5]) for r in rows], score) and len(set(got.values())) < 60


def test_cluster_order_of_rules(spark):
    p = lambda i: '{"measurements":{"provider_event_id":"%s"}}' % i
    rows = [
        ("a1", "s", "Strong quake near harbour city", None, "n", at(0), None, None, "PT", p(1), "h1"),
        ("a2", "s", "Strong quake near harbour city", None, "n", at(1), None, None, "PT", p(2), "h2"),
        ("a3", "s", "Later words of another kind", None, "n", at(2), None, None, "PT", p(1), "h3"),
        ("a4", "t", "Same text elsewhere", None, "n", at(3), None, None, None, "{}", "h1"),
        ("a5", "t", "Strong quake near harbour city", None, "n", at(4), None, None, "ES", "{}", "h5"),
        ("a6", "t", "Strong quake near harbour city", None, "unclassified", at(5), None, None, "PT", "{}", "h6"),
    ]
    got = {r["article_id"]: (r["event_article_id"], r["how"]) for r in cluster.cluster(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert got["a2"] == ("a2", "new") and got["a3"] == ("a1", "provider") and got["a4"] == ("a1", "duplicate") and got["a5"] == ("a5", "new")
    assert got["a6"][1] == "similar"


EVENT = "id int, title string, category string, country string, place string, lat double, lon double, geo_precision string, last_activity_at timestamp"


def test_graph_relations(spark):
    rows = [
        (1, "a", "war_conflict", "PT", None, 38.7, -9.1, "exact", at(0)), (2, "b", "energy", "PT", None, 38.8, -9.2, "exact", at(10)),
        (3, "c", "health", "PT", "Porto", 41.1, -8.6, "approximate", at(100)), (4, "d", "health", "PT", "Porto", 41.1, -8.6, "approximate", at(101)),
        (5, "e", "health", "PT", "Porto", 41.1, -8.6, "unknown", at(101)),
    ]
    got = {(r["from_id"], r["to_id"], r["kind"]): r["strength"] for r in graph.relate(spark.createDataFrame(rows, EVENT)).collect()}
    assert got[3, 4, "same_location"] == 45 and got[1, 2, "same_location"] > 85 and got[1, 2, "cross_domain_impact"] == 60 and got[3, 4, "temporal_sequence"] == 74
    assert not any(5 in k[:2] for k in got)


def test_actors_ignore_furniture(spark):
    rows = [(1, "Maria Silva"), (1, "Porto City"), (1, "Reuters"), (2, "Maria Silva"), (2, "Porto City"), (3, "Maria Silva"), (3, "Reuters")]
    e = spark.createDataFrame(rows, "event_id int, name string")
    when = spark.createDataFrame([(1, at(0)), (2, at(3)), (3, at(4)), (4, at(400))], "id int, last_activity_at timestamp")
    none = spark.createDataFrame([], "name string, df long")
    assert [(r["from_id"], r["to_id"], r["strength"]) for r in graph.same_actor(e, when, none).collect()] == [(1, 2, 64)]
    late = e.filter("event_id = 2").withColumn("event_id", F.lit(4)).unionByName(e.filter("event_id = 1"))
    assert graph.same_actor(late, when, none).count() == 0  # too far apart in time
    assert graph.same_actor(e, when).count() == 0  # names in three of three events are common


def test_radius_join_over_poles_and_date_line(spark):
    import math
    import random

    rng = random.Random(1)
    pts = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(300)] + [(900, 89.9, 0.0), (901, 89.9, 180.0), (902, 0.0, 179.9), (903, 0.0, -179.9), (904, None, None)]
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {(r["a_id"], r["b_id"]) for r in J.radius_join(p, p, 500).collect()}

    def km(a, b):
        s = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(s)))

    assert got == {(a[0], b[0]) for a in pts[:-1] for b in pts[:-1] if km(a, b) < 500} and (900, 901) in got and (902, 903) in got


def test_supervision(spark):
    e = spark.createDataFrame([(1, "t", "health", 80, 40), (2, "t", "health", 20, 40), (3, "other", "health", 80, 40), (4, "t", "unclassified", 60, 90)], "event_id int, title string, category string, confidence int, life_impact int")
    a = spark.createDataFrame([(i, "t", "https://x", at(0)) for i in (1, 2, 3, 4)], "event_id int, title string, url string, published_at timestamp")
    got = {r["event_id"]: (r["decision"], r["publish"], r["priority"]) for r in review.quality_gate(review.supervise(e, a)).collect()}
    assert got == {1: ("APPROVE", True, None), 2: ("REVIEW_REQUIRED", False, 50), 3: ("BLOCK", False, 90), 4: ("REVIEW_REQUIRED", False, 50)}
    events = e.withColumns({"status": F.lit("SUPERVISOR_REVIEW"), "published_at": F.lit(None).cast("timestamp")})
    d = spark.createDataFrame([(1, "approve", None), (2, "reject", None), (3, "override", "ARCHIVED")], "event_id int, decision string, state string")
    after, history = review.review_resolution(events, d, F.lit(at(9)))
    assert {r["event_id"]: r["status"] for r in after.collect()} == {1: "PUBLISHED", 2: "REJECTED", 3: "ARCHIVED", 4: "SUPERVISOR_REVIEW"} and history.count() == 3


def test_rules(spark):
    cols = "user_id int, rule_id int, name string, category string, country string, min_confidence int, min_impact int, min_relevance int, only_verified boolean, enabled boolean"
    rows = [(1, 1, "x", "health", None, None, None, None, False, True), (1, 2, "none", None, None, None, None, None, False, True), (1, 3, "range", None, None, 101, None, None, False, True), (1, 4, "fine", None, None, 50, None, None, False, True)]
    r = spark.createDataFrame(rows, cols)
    got = {x["rule_id"]: x["error"] for x in products.validate_rules(r).collect()}
    assert got == {1: "name_too_short", 2: "no_criterion", 3: "threshold_out_of_range", 4: None}
    e = spark.createDataFrame([(7, "PUBLISHED", "health", "PT", None, None, None, "VERIFIED", at(0), at(0)), (8, "PUBLISHED", "health", "PT", 60, None, None, "VERIFIED", at(0), at(0))], "event_id int, status string, category string, country string, confidence int, life_impact int, relevance int, verification string, published_at timestamp, last_activity_at timestamp")
    none = spark.createDataFrame([], "user_id int, rule_id int, event_id int")
    found = products.match_alerts(r.filter("rule_id = 4"), e, none, F.lit(at(1)))
    assert [x["event_id"] for x in found.collect()] == [8]  # an unknown score never passes
    assert products.match_alerts(r.filter("rule_id = 4"), e, found, F.lit(at(1))).count() == 0


def test_rules_join_by_what_they_name(spark):
    cols = "user_id int, rule_id int, category string, country string, min_confidence int, min_impact int, min_relevance int, only_verified boolean, enabled boolean"
    rows = [(i, i, ["a", None][i % 2], ["PT", None][i // 2 % 2], None, None, None, False, True) for i in range(8)]
    r = spark.createDataFrame(rows, cols)
    e = spark.createDataFrame([(1, "a", "PT"), (2, "b", "PT"), (3, "b", None)], "event_id int, category string, country string").withColumns({"confidence": F.lit(1), "life_impact": F.lit(1), "relevance": F.lit(1), "verification": F.lit("x")})
    got = [(x["rule_id"], x["event_id"]) for x in J.rule_matches(r, e).collect()]
    want = [(x["rule_id"], y["event_id"]) for x in r.collect() for y in e.collect() if all(x[c] is None or x[c] == y[c] for c in ("category", "country"))]
    assert sorted(got) == sorted(want)
    plan = J.rule_matches(r, e)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_of_equal_criteria_and_what_was_told(spark):
    """The newest few of each rule that it hasn't told of; rules that name nothing reach events by their confidence."""
    rng = random.Random(3)
    cols = "user_id int, rule_id int, name string, category string, country string, min_confidence int, min_impact int, min_relevance int, only_verified boolean, enabled boolean"
    rules = [(i, i, "r", rng.choice(["a", "b", None]), rng.choice(["PT", None]), rng.choice([None, 20, 60]), rng.choice([None, 30]), None, rng.random() < 0.3, rng.random() < 0.9) for i in range(30)]
    events = [(i, "PUBLISHED", rng.choice("ab"), rng.choice(["PT", "ES"]), rng.choice([None, 10, 50, 90]), rng.choice([None, 40]), None, rng.choice(["VERIFIED", "UNCERTAIN"]), at(i % 7), at(0)) for i in range(40)]
    told = [(r[0], r[1], rng.randrange(40)) for r in rules for _ in range(6)]
    r = spark.createDataFrame(rules, cols)
    e = spark.createDataFrame(events, "event_id int, status string, category string, country string, confidence int, life_impact int, relevance int, verification string, published_at timestamp, last_activity_at timestamp")
    got = {}
    for x in products.match_alerts(r, e, spark.createDataFrame(told, "user_id int, rule_id int, event_id int"), F.lit(at(10)), per_rule=3).collect():
        got.setdefault(x["rule_id"], set()).add(x["event_id"])
    for u, i, _, cat, land, conf, imp, _, ver, on in rules:
        fits = [
            v for v in events
            if on and cat in (None, v[2]) and land in (None, v[3]) and (v[4] if v[4] is not None else -1) >= (-1 if conf is None else conf) and (v[5] if v[5] is not None else -1) >= (-1 if imp is None else imp)
            and (not ver or v[7] == "VERIFIED") and (u, i, v[0]) not in told
        ]
        fits.sort(key=lambda v: v[0])
        fits.sort(key=lambda v: v[8], reverse=True)
        assert got.get(i, set()) == {v[0] for v in fits[:3]}


def test_long_chains_cluster(spark):
    """Five hundred articles, each like the one before: every second one founds an event, as in a walk."""
    words = [f"longword{i:04}" for i in range(503)]
    rows = [(f"a{i:04}", "s", " ".join(words[i : i + 3]), None, "n", at(i), None, None, "PT", "{}", f"h{i}") for i in range(500)]
    got = {r["article_id"]: (r["event_article_id"], r["how"]) for r in cluster.cluster(spark.createDataFrame(rows, ARTICLE)).collect()}
    assert all(got[f"a{i:04}"] == ((f"a{i:04}", "new") if i % 2 == 0 else (f"a{i - 1:04}", "similar")) for i in range(500))


def test_founders_are_those_of_a_walk(spark, monkeypatch):
    rng = random.Random(8)
    pairs = sorted({(b, a, at(b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a < b} | {(i + 1, i, at(i + 1)) for i in range(60, 90)})
    heads = set()
    for i in range(100):
        if not any(b == i and a in heads for b, a, _ in pairs):
            heads.add(i)
    p = spark.createDataFrame(pairs, "later int, earlier int, later_at timestamp")
    for rounds in (0, 2, 8):
        assert {r["id"] for r in cluster.founders(spark.range(100), p, rounds).collect()} == heads


def test_grounding(spark):
    a = spark.createDataFrame([(1, "The Mayor said", "the bridge, is closed today"), (2, "Other", "text")], "article_id int, title string, summary string")
    rows = [(1, 1, 1, "THE BRIDGE is closed", "fact"), (1, 2, 1, "the bridge was closed", "FACT"), (1, 3, 2, "the bridge is closed", "FACT"), (1, 4, 9, "the bridge is closed", "FACT"), (1, 5, 1, "bridge", "FACT"), (1, 6, 1, "the bridge is closed", "RUMOUR"), (1, 7, 1, None, None)]
    c = spark.createDataFrame(rows, "run_id int, claim_no int, article_id int, quote string, kind string")
    got = {r["claim_no"]: r["why"] for r in enrich.ground_quotes(c, a).filter("claim_no < 7").collect()}
    assert got == {1: None, 2: "not_in_article", 3: "not_in_article", 4: "no_such_article", 5: "too_short", 6: "unknown_kind"}
    assert enrich.run_status(c, enrich.ground_quotes(c, a)).first()["status"] == "blocked"


def test_passages_are_grounded_in_all_documents(spark, tmp_path):
    from tidewater.functions.text import fold_text
    from tidewater.queries import queries

    said = "the old bridge over the river was closed by the mayor on monday"
    items = [(1, said), (2, "closed by the mayor"), (3, "bridge closed"), (4, "nobody ever wrote this line of eleven words down at all"), (5, "short"), (6, "...")]
    # more than 40 holders, ids of every residue and far beyond 800, words cut at both ends, accents and line feeds
    docs = [(i, f"report {i}\nwe heard {said} again") for i in range(790, 860)] + [(90_017, "BREATHE Old bridge\nover the River wás closed by the mayor on mondays"), (90_018, "the old bridge over the river was closed by the mayor"), (90_019, None), (90_020, "short"), (90_021, "A bridge closed")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in queries()["grounded_quotes"](spark, str(tmp_path)).select("run_id", "article_id", "kept").collect()]
    fold = lambda table: {r[0]: r[1] or "" for r in spark.createDataFrame(table, "k long, t string").select("k", fold_text(F.col("t"))).collect()}
    hays, quotes = fold(docs), fold(items)
    want = {(q, a) for q, f in quotes.items() for a, h in hays.items() if f and len(dict(items)[q].strip()) >= 12 and f in h}
    assert {(q, a) for q, a, kept in rows if kept} == want and (1, 90_017) in want and len(want) > 80
    assert len(rows) == len({r[:2] for r in rows}) and (1, 90_018, False) in rows and (5, 90_020, False) in rows
    stats = {r["run_id"]: (r["proposed"], r["kept"]) for r in queries()["grounding_stats"](spark, str(tmp_path)).collect()}
    assert stats[1] == (72, 71) and 4 not in stats


def test_whole_texts_are_read(spark, tmp_path):
    """Terms, places and names behind the first 1200 characters count."""
    from tidewater.queries import queries

    late = "words and more\n" + "so it is. " * 200 + "they heed it in erst with Orlando Vantorre and Orlando Vantorre."
    docs = [(i, late, "en", "s") for i in range(1, 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: queries()[name](spark, str(tmp_path)).collect()
    assert [(r["category"], r["score"]) for r in rows("classify_docs")] == [("politics", 2)] * 4
    assert [(r["country"], r["place"]) for r in rows("geocode_docs")] == [("XB", "Erst")] * 4
    assert {r["mentions"] for r in rows("entity_mentions") if r["name"] == "Orlando Vantorre"} == {2}
    assert ("orlando vantorre", 4) in {tuple(r) for r in rows("common_entities")}


def test_conflicts_keep_all_values(spark):
    a = spark.createDataFrame([(1, "Magnitude 6.1 hits", None), (1, "Magnitude 6,3 felt", None), (2, "Magnitude 5", None), (3, "1,200 dead", None), (3, "1200 killed", None)], "event_id int, title string, summary string")
    assert [(r["event_id"], r["field"], r["values"]) for r in enrich.detect_conflicts(a).collect()] == [(1, "magnitude", ["6.1", "6.3"])]


def test_feed(spark):
    body = """<rss><item><title>No link</title></item><item><title><![CDATA[A &amp; <b>B</b>]]></title><link>https://x/1</link><pubDate>bad</pubDate>
    <geo:lat>91</geo:lat><geo:long>0</geo:long><gdacs:eventid>77</gdacs:eventid></item><entry><title>E</title><link rel="alternate" href="https://x/2?a=1&amp;b=2"/><summary>s</summary></entry>
    <item><title>G</title><guid>https://x/3</guid><georss:point>10.5 -20</georss:point>Magnitude 5.5M</item></rss>"""
    items = feeds.extract_measurements(feeds.extract_feed_geo(feeds.parse_feed(spark.createDataFrame([(body,)], "body string"), F.lit(at(0)))))
    got = {r["link"]: r for r in items.collect()}
    assert set(got) == {"https://x/1", "https://x/2?a=1&b=2", "https://x/3"}
    assert got["https://x/1"]["title"] == "A & B" and got["https://x/1"]["published_at"] is None and got["https://x/1"]["lat"] is None and got["https://x/1"]["measurements"] == {"provider_event_id": "77"}
    assert (got["https://x/3"]["lat"], got["https://x/3"]["lon"]) == (10.5, -20.0) and got["https://x/3"]["measurements"] == {"magnitude": "5.5"} and got["https://x/2?a=1&b=2"]["measurements"] is None
    new = feeds.insert_new_articles(items.unionByName(items), spark.createDataFrame([("ART-x",)], "article_id string"))
    assert new.count() == 3


def test_quakes(spark):
    body = '{"features":[{"id":"q1","properties":{"title":"M 5","url":"https://q/1","time":1704164645000,"mag":5.1},"geometry":{"coordinates":[-9.5,38.1,11.0]}},{"id":"q2","properties":{"title":"no url"}}]}'
    r = feeds.parse_quake_geojson(spark.createDataFrame([(body,)], "body string")).collect()
    assert len(r) == 1 and (r[0]["lat"], r[0]["lon"]) == (38.1, -9.5) and r[0]["measurements"]["depth_km"] == "11.0"


def test_fold_and_health(spark):
    log = spark.createDataFrame([(1, "a", "add", at(0), 1), (1, "a", "add", at(1), 2), (1, "b", "add", at(0), 3), (1, "b", "remove", at(1), 4), (1, "c", "toggle", at(0), 5), (1, "c", "toggle", at(1), 6), (1, "c", "toggle", at(2), 7)], "user_id int, target string, action string, at timestamp, id int")
    assert sorted(r["target"] for r in ledgers.fold_changes(log, ["user_id", "target"]).collect()) == ["a", "c"]
    attempts = spark.createDataFrame([("s", at(0), 1, False, 0, 1), ("s", at(1), 2, True, 3, 0), ("s", at(2), 3, False, 0, 2), ("s", at(3), 4, False, 0, 1), ("t", at(0), 5, True, 0, 0)], "source_id string, at timestamp, id int, ok boolean, items int, parse_failures int")
    got = {r["source_id"]: (r["status"], r["consecutive_fails"], r["parse_failures"]) for r in feeds.source_health(attempts).collect()}
    assert got == {"s": ("offline", 2, 3), "t": ("degraded", 0, 0)}


def test_retention(spark):
    old, new, now = at(-24 * 100), at(-1), F.lit(at(0))
    mk = spark.createDataFrame
    tables = {
        "article": mk([("a1", 1, old, "p"), ("a2", 1, new, "p"), ("a3", None, old, "p")], "article_id string, event_id int, published_at timestamp, payload string"),
        "run": mk([(1, 1, "x", old), (2, 1, "x", old + timedelta(hours=1))], "run_id int, event_id int, agent string, at timestamp"),
        "audit": mk([("login", old, None), ("login", new, None)], "action string, at timestamp, detail string"),
        "view": mk([(1, old), (1, new)], "event_id int, at timestamp"),
        "event": mk([(1, "PUBLISHED", old), (2, "CLUSTERED", old), (3, "CLUSTERED", old), (4, "CLUSTERED", new)], "event_id int, status string, last_activity_at timestamp"),
        "edge": mk([(2, 3, "k", old), (1, 2, "k", old)], "from_id int, to_id int, kind string, created_at timestamp"),
        "review": mk([(1, 1, old), (2, 1, new)], "review_id int, event_id int, reviewed_at timestamp"),
        "queue": mk([(9, "open")], "event_id int, state string"),
        "follow": mk([(1, "event", "3")], "user_id int, kind string, target string"),
        "bookmark": mk([], "user_id int, event_id int"),
    }
    report, after = retention.retain(tables, now, dry_run=True)
    assert after == {} and {r["step"]: r["rows"] for r in report.collect()} == {"payloads": 1, "runs": 1, "audit": 1, "views": 1, "events": 1, "edges": 1, "reviews": 1}
    _, after = retention.retain(tables, now, dry_run=False)
    assert sorted(r["event_id"] for r in after["event"].collect()) == [1, 3, 4] and after["article"].count() == 3
    assert [r["detail"] for r in after["audit"].filter("action = 'audit.archived'").collect()] == ["login=1"]
    with pytest.raises(ValueError):
        retention.Policy(run_days=float("nan"))
    with pytest.raises(ValueError):
        retention.Policy().with_(view_days=-1)


def test_export_and_erasure(spark):
    who = spark.createDataFrame([(1,), (2,)], "user_id int")
    t = {"follows": spark.createDataFrame([(1, "a"), (3, "b")], "user_id int, target string")}
    got = {r["user_id"]: r["follows"] for r in ledgers.subject_export(who, t).collect()}
    assert got == {1: '[{"target":"a"}]', 2: "[]"}
    assert [r["user_id"] for r in ledgers.subject_erasure(who, t)["follows"].collect()] == [3]


def test_common_entities_floor(spark):
    e = spark.createDataFrame([(i, "Name") for i in range(3)] + [(9, "Rare")], "event_id int, name string")
    assert [(r["name"], r["df"]) for r in A.common_entities(e).collect()] == [("name", 3)]


def test_events_alike_are_cut_before_rules_meet_them(spark, monkeypatch):
    """A rule that has told of three of forty equal events is told of the next 25, and no more than it needs meets it."""
    from tidewater.plans import products

    met = []
    monkeypatch.setattr(products, "rule_matches", lambda r, e, f=products.rule_matches: met.append(e.count()) or f(r, e))
    at = "timestamp'2024-01-02 00:00:00' - make_interval(0, 0, 0, 0, 0, cast(id as int))"
    events = spark.range(40).selectExpr("id as event_id", "'PUBLISHED' as status", "'economy' as category", "'X' as country", f"{at} as published_at", "50 as confidence", "id as relevance", "50 as life_impact", "'VERIFIED' as verification")
    rules = spark.createDataFrame([(1, 1, "economy", True), (2, 2, "economy", True)], "user_id long, rule_id long, category string, enabled boolean")
    rules = rules.selectExpr("*", "cast(null as string) as country", "cast(null as int) as min_confidence", "cast(null as int) as min_impact", "cast(null as int) as min_relevance", "false as only_verified")
    told = spark.createDataFrame([(1, 1, i) for i in (0, 3, 5, 5, 99)], "user_id long, rule_id long, event_id long")
    got = products.match_alerts(rules, events, told, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()
    assert sorted(r["event_id"] for r in got if r["rule_id"] == 1) == [i for i in range(28) if i not in (0, 3, 5)]
    assert sorted(r["event_id"] for r in got if r["rule_id"] == 2) == list(range(25))
    assert met == [28]


def test_conflicts_deal_an_article_once(spark):
    from tidewater.plans import enrich

    rows = [(1, "magnitude 5, 3 killed"), (1, "magnitude 6, 3 killed"), (2, "magnitude 5"), (None, "magnitude 5"), (None, "magnitude 6"), (3, "3 injured"), (3, None), (3, "4 injured")]
    df = spark.createDataFrame(rows, "event_id long, title string").withColumn("summary", F.lit(None).cast("string"))
    found = enrich.detect_conflicts(df)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "magnitude", ["5", "6"]), (3, "injured", ["3", "4"])]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_pages_are_put_together_in_one_join(spark):
    from tidewater.plans import products

    ids = spark.createDataFrame([(1,), (2,)], "event_id long")
    a = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (3, 1)], "event_id long, id long")
    b = spark.createDataFrame([(2, "x"), (2, "y")], "event_id long, id string")
    out = products.event_detail(ids, {"a": (a, [F.desc("id")], 2), "b": (b, [F.asc("id")], None), "c": (a, [F.asc("id")], None)})
    got = {r["event_id"]: [[x["id"] for x in r[k]] for k in "abc"] for r in out.collect()}
    assert got == {1: [[7, 6], [], [5, 6, 7]], 2: [[], ["x", "y"], []]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
