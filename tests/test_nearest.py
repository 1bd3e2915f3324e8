"""Nearest partners in time and topics by heavy words, against all pairs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewater.operators import joins
from tidewater.operators.aggregates import idf_weights
from tidewater.plans import graph

EVENT = "id int, title string, category string, country string, place string, lat double, lon double, geo_precision string, last_activity_at timestamp, status string"
START = datetime(2024, 1, 1)


def crowded(spark, rng, n=500):
    """A busy fortnight of one country with bursts at one time, a quiet country, and rows that have no country, category or time."""
    rows = []
    for i in range(n):
        busy = rng.random() < 0.8
        minutes = rng.choice([60 * 30, 60 * 31, rng.randrange(60 * 24 * 4), rng.randrange(60 * 24 * 14)]) if busy else rng.randrange(60 * 24 * 60)
        when = None if i % 97 == 0 else START + timedelta(minutes=minutes)
        category = rng.choice(["energy", "economy", "politics", "general_news"]) if i % 89 else None
        rows.append((i, f"t {i}", category, ("A" if busy else "B") if i % 83 else None, None, None, None, "approximate", when, "PUBLISHED" if rng.random() < 0.7 else "CLUSTERED"))
    return spark.createDataFrame(rows, EVENT)


def shown_edges(edges, events, n):
    top = joins.neighbours(edges, events.withColumnRenamed("id", "event_id"), n).select("event_id", "other_id", "kind", "strength")
    return sorted(map(tuple, top.collect()))


def test_nearest_partners_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    events, published = crowded(spark, rng).cache(), F.col("status") == "PUBLISHED"
    all_pairs = joins.concat([graph.temporal_sequence(events), graph.cross_domain(events)]).cache()
    for n in (2, 8):
        edges = joins.concat([graph.nearest_sequence(events, n, shown=published), graph.nearest_domains(events, n, shown=published)]).cache()
        want = shown_edges(all_pairs, events, n)
        assert want and shown_edges(edges, events, n) == want
        assert {tuple(r) for r in edges.collect()} <= {tuple(r) for r in all_pairs.collect()}  # edges of the whole graph, basis included


def test_a_busy_country_forms_few_pairs(spark):
    rows = [(i, "t", "energy", "A", None, None, None, "approximate", START + timedelta(minutes=2 * i), "PUBLISHED") for i in range(3000)]
    events = spark.createDataFrame(rows, EVENT)
    few, many = graph.nearest_sequence(events).count(), graph.temporal_sequence(events).count()
    assert few * 15 < many


def test_no_events_no_edges(spark):
    assert graph.relate_nearest(spark.createDataFrame([], EVENT)).count() == 0


def test_topics_meet_by_heavy_words(spark):
    rng = random.Random(9)
    common = [f"common{i}" for i in range(8)]  # in a fifth of all titles each, so of idf above 1.5
    rows = []
    for i in range(600):
        own = [f"w{rng.randrange(900):03d}" for _ in range(4)]
        title = " ".join(own + [w for w in common if rng.random() < 0.2])
        if i % 10 == 9:
            title = rows[-1][1] + " again"
        rows.append((i, title, "x", None, None, None, None, "unknown", START + timedelta(minutes=i), "PUBLISHED"))
    events = spark.createDataFrame(rows, EVENT)
    idf = {r["token"]: r["idf"] for r in idf_weights(events).collect()}
    sets = {r[0]: set(r[1].split()) for r in rows}
    want, meet = {}, 0
    for a in sets:
        for b in range(a + 1, 600):
            both = sets[a] & sets[b]
            rare = sum(idf[w] > 1.5 for w in both)
            meet += rare
            s, t = sum(idf[w] for w in both), sum(idf[w] for w in sets[a] | sets[b])
            if rare >= 2 and s / t >= 0.30:
                want[a, b] = min(85, int(s / t * 120 + 0.5))
    got = {(r["from_id"], r["to_id"]): r["strength"] for r in graph.same_topic(events).collect()}
    assert want and got == want
    met = graph.topic_meetings(graph.topic_words(events, idf_weights(events)))
    assert met.count() * 10 < meet  # formed before the bound, against what meets by any rare token
    assert met.filter("bound").count() < met.count()


def test_pairs_are_counted_by_their_times(spark):
    """Counts are those of the pairs, and of many events at one time one row a time is joined."""
    rows = [(i, f"t{i}", "economy" if i % 3 else "politics", "XA" if i % 4 else "XB", None, i % 5 / 10 if i % 2 else None, 20.0 if i % 2 else None, "exact" if i % 2 else "approximate", datetime(2024, 1, 1 + i % 10), "PUBLISHED") for i in range(80)]
    events = spark.createDataFrame(rows, EVENT).cache()
    each = graph.event_pairs(events, ["category"], []).groupBy("category", "h").count()
    assert {tuple(r) for r in graph.pair_counts(events, ["category"]).select("category", "h", "n").collect()} == {tuple(r) for r in each.collect()}
    assert graph._moments(events, ["category"]).count() <= 20
    edges = joins.concat([graph.same_location(events), graph.temporal_sequence(events), graph.cross_domain(events)])
    want = {tuple(r) for r in edges.groupBy("kind", "strength").count().collect()}
    assert {tuple(r) for r in graph.edge_counts(events).select("kind", "strength", "n").collect()} == want and len({k for k, *_ in want}) == 3
    assert edges.count() == edges.select("from_id", "to_id", "kind").distinct().count()


def scattered(spark, rng, n=600):
    """Events at the poles, the date line, in a city, at one spot, on a grid and nowhere, of named places, with countries or none, dense and sparse in time."""
    spots = [
        lambda: (rng.choice([90.0, 89.9, 89.5, 88.6, -90.0]), rng.uniform(-180, 180)), lambda: (rng.uniform(-2, 2), rng.choice([179.9, -179.9, 180.0, -180.0, 178.5])),
        lambda: (40 + rng.uniform(0, 0.2), 20 + rng.uniform(0, 0.2)), lambda: (40.0, 20.0), lambda: (float(rng.randrange(36, 45)), float(rng.randrange(16, 26))), lambda: (95.0, 10.0), lambda: (None, None),
    ]
    rows = []
    for i in range(n):
        lat, lon = rng.choice(spots)()
        precision = rng.choice(["exact", "exact", "exact", "approximate", "unknown", None])
        hours = rng.choice([rng.randrange(24 * 40), rng.randrange(24 * 4), 24 * rng.randrange(12), 168 * rng.randrange(4), rng.uniform(0, 24 * 12)])
        when = None if i % 97 == 0 else START + timedelta(hours=hours)
        category = rng.choice(["energy", "economy", "politics", "general_news", None])
        rows.append((i, f"t {i}", category, rng.choice(["A", "A", "B", "C", None]), rng.choice(["p", "q", None]), lat, lon, precision, when, "PUBLISHED" if rng.random() < 0.7 else "CLUSTERED"))
    return spark.createDataFrame(rows, EVENT)


def test_related_events_are_the_strongest_of_all_edges(spark):
    events, published = scattered(spark, random.Random(11)).cache(), F.col("status") == "PUBLISHED"
    edges = joins.concat([graph.same_location(events), graph.temporal_sequence(events), graph.cross_domain(events)]).cache()
    assert edges.count() == edges.select("from_id", "to_id", "kind").distinct().count()
    for n in (1, 3, 8):
        want = shown_edges(edges, events, n)
        got = sorted(map(tuple, graph.related(events, n, published).select("event_id", "other_id", "kind", "strength").collect()))
        assert got == want and {k for *_, k, _ in want} == set(graph.RELATED_KINDS)
    few = events.filter(published)  # all that are there are shown
    want = shown_edges(joins.concat([graph.same_location(few), graph.temporal_sequence(few), graph.cross_domain(few)]), few, 8)
    assert sorted(map(tuple, graph.related(few).collect())) == want


def test_crowded_spots_and_places_form_few_pairs(spark):
    """Reports of one week from fifty spots of one region, and as many that name one place: no table of all pairs."""
    at = lambda i: datetime(2024, 1, 4) + timedelta(hours=i % 7 * 24)
    rows = [(i, "t", None, "A", None, 40 + i % 10 / 10, 20 + i // 10 % 5 / 10, "exact", at(i), "PUBLISHED") for i in range(1000)]
    rows += [(i, "t", None, "A", "p", None, None, "approximate", at(i), "PUBLISHED") for i in range(1000, 2000)]
    events = spark.createDataFrame(rows, EVENT).cache()
    lists = graph.moment_partners(events).cache()
    all_pairs = graph.same_location(events).count()
    near, placed = graph._near_partners(events, lists, 8, None).count(), graph._place_partners(events, lists, 8, None).count()
    assert placed <= 9 * 1000 and (near + placed) * 5 < 2 * all_pairs  # an edge is a partner at both its ends
    assert sorted(map(tuple, graph.related(events).collect())) == shown_edges(graph.same_location(events), events, 8)
