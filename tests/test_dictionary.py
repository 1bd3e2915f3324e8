"""Names in texts against patterns tried one by one, and plans without nested loops."""

import random
import re

from pyspark.sql import functions as F

from tidewater.functions.text import term_match
from tidewater.operators.dictionary import contained_in, named_in
from tidewater.plans import enrich

NAMES = ["erst", "of the", "new york city hall", "covid-19", "c++", "état", "café", ".net", "+++", "'s-herto", "a", "of the house of", "  ", "é", "…", "19"]
TEXTS = [
    " erst of  the  of the house ", "new york city hall", "new york city halls", "anew york city hall", "covid-19 and covid 19", "c++ c+", "l'état xétat", "cafés café", "asp.net", "a+++b",
    "x's-herto 's-herto", "", None, "of the house of cards", "of,the", "word2erst", "erst2", "… é", "new\nyork city hall",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark, names=NAMES, texts=TEXTS):
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return t, spark.createDataFrame([(n, n) for n in names], "name_id string, name string")


def test_whole_words(spark):
    t, n = frames(spark)
    n = n.filter("not name rlike '^[à-ÿ]|[à-ÿ]$'")
    got = sorted(map(tuple, named_in(t, n, "a-zà-ÿ0-9", term_match).collect()))
    want = t.crossJoin(n).filter(F.col("text").isNotNull() & term_match(F.col("text"), F.col("name"))).select("id", "name_id")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 10
    assert named_in(t, n.limit(0), "a-z", term_match).collect() == []


def test_parts_of_words(spark):
    t, n = frames(spark)
    got = sorted(map(tuple, contained_in(t, n.filter("name <> ''")).collect()))
    assert got == sorted((i, x) for i, text in enumerate(TEXTS) for x in NAMES if text is not None and x in text)


def test_random_names(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("ab1", k=rng.randint(1, 3)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(200)})
    texts = ["".join(rng.choice([word(), word(), " ", ",", " "]) for _ in range(60)) for _ in range(30)]
    t, n = frames(spark, names, texts)
    got = set(map(tuple, named_in(t, n, "a-z0-9", term_match).collect()))
    want = {(i, x) for i, text in enumerate(texts) for x in names if re.search(f"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])", text)}
    assert got == want and len(got) > 100


def test_a_million_names(spark):
    """No refusal and no nested loop, with more names than are sent to every task."""
    a = spark.createDataFrame([(1, "s", "Orange lamp", "seen in place hhhhhh today"), (2, "s", "Place hhhhhhs", None)], "article_id int, source_id string, title string, summary string")
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    places = spark.range(1_000_001).select(F.concat(F.lit("place "), word).alias("name"), F.lit("XA").alias("country"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("city").alias("kind"), F.col("id").alias("ordinal"))
    found = enrich.geocode(a, places)
    assert {r["article_id"]: r["place"] for r in found.collect()} == {1: "Place Hhhhhh", 2: None}
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_names_that_begin_alike_leave_no_task_unless_they_occur(spark, monkeypatch):
    from tidewater.operators import dictionary

    kept = []
    monkeypatch.setattr(dictionary, "saved", lambda df, f=dictionary.saved: kept.append(out := f(df)) or out)
    names = spark.createDataFrame([(f"nation_{i}", f"nation_{i}") for i in range(20)], "name_id string, name string")
    texts = spark.createDataFrame([(i, " in nation_13 ") for i in range(30)], "id long, text string")
    found = sorted(tuple(r) for r in dictionary.contained_in(texts, names).collect())
    assert found == sorted((i, n) for i in range(30) for n in ("nation_1", "nation_13"))
    assert max(df.count() for df in kept) == 20
    monkeypatch.setattr(dictionary, "SENT", 0)
    assert sorted(tuple(r) for r in dictionary.contained_in(texts, names).collect()) == found
