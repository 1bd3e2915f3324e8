from datetime import datetime

from pyspark.sql import functions as F

from tidewater.functions import measures as M
from tidewater.functions import text as X


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_fold_and_tokens(spark):
    assert one(spark, X.fold_text(F.col("t")), t="Élan,  VITAL — n°2!") == "elan vital n 2"
    assert one(spark, X.tokens(F.col("t")), t="The sea and the Sea: após mar, ok, novo") == ["sea", "apos", "mar", "novo"]  # stop words are compared after folding
    assert one(spark, X.fold_text(F.col("t")), t="") == ""


def test_ids(spark):
    assert one(spark, X.article_id(F.col("u")), u="http://a").startswith("ART-")
    assert len(one(spark, X.article_id(F.col("u")), u="http://a")) == 20
    e = one(spark, X.event_id(F.col("u"), F.col("w")), u="seed", w=datetime(2024, 3, 5))
    assert e.startswith("EVT-2024-03-05-") and len(e) == 23
    assert one(spark, X.slugify(F.col("t")), t="  Óla, Mundo! ") == "ola-mundo"
    assert one(spark, X.slugify(F.col("t")), t="???") == "event"
    assert one(spark, X.content_hash(F.col("a"), F.lit(None).cast("string")), a="A b") == one(spark, X.content_hash(F.col("a"), F.lit("")), a="a  B")
    assert len(one(spark, X.session_hash(F.lit("2024-01-01"), F.lit("ip"), F.lit("ua"), "salt"))) == 32


def test_terms_are_whole_words(spark):
    hit = lambda text, term: one(spark, X.term_match(F.col("t"), term), t=text)
    assert hit("the ESA said", "esa")
    assert not hit("a mesa grande", "esa")
    assert not hit("esaç", "esa")
    assert hit("inundações", "inundaç")
    assert not hit("anything", " ")


def test_markup(spark):
    text = "<![CDATA[<b>A</b> &amp; B]]> &#233;&#x41;&lt;x&gt;&nbsp; &#xFFFFFF;"
    assert one(spark, X.strip_markup(F.col("t")), t=text) == "A & B éA<x> �"


def test_dates(spark):
    at = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    got = lambda s: one(spark, F.unix_seconds(X.parse_date(F.col("t"), at)), t=s)
    want = 1704164645
    assert got("Tue, 02 Jan 2024 03:04:05 GMT") == want
    assert got("2 Jan 2024 04:04:05 +0100") == want
    assert got("2024-01-02T03:04:05Z") == want
    assert got("2024-01-02T05:04:05+02:00") == want
    assert got("nonsense") is None and got("1 Jan 1980 00:00:00 GMT") is None and got("1 Jan 2030 00:00:00 GMT") is None


def test_entities(spark):
    got = one(spark, X.entity_candidates(F.col("t")), t="Rio de Janeiro met Maria Silva. The An Go Go Ab")
    assert "Rio de Janeiro" in got and "Maria Silva" in got and "The" not in got and not any(e.startswith("Go Go") for e in got)


def test_entities_keep_their_ends(spark):
    text = "Key0 met, Key11 met, Key2222 met"
    assert one(spark, X.entity_candidates(F.col("t")), t=text) == ["Key0", "Key11", "Key2222"]
    assert one(spark, X.entity_candidates(F.col("t")), t="xAbc 1Abc _Abc \u00d7abc e\u0301Abc Ab\x0bCd") == ["\u00d7abc", "Abc Ab"]


def test_letters_beyond_the_first_plane_stand_before_no_entity(spark):
    assert one(spark, X.entity_candidates(F.col("t")), t="\U0001d400Abc \U00020000Def \U0001f600Ghi met") == ["Ghi"]


def test_folding_in_one_pass(spark):
    """No pass for each kind of character, and a hash that folds no more of a long text than it takes."""
    texts = ["", "!!", "  a  b", "\u00e9\u00e1b \u00c7", "the The x1 y2 123 abc\n\tdef", "a" * 399 + "!b", "a" * 1600 + " b", "! " * 900 + "tail word", "ab " * 133 + "x yz"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    slow = F.trim(F.regexp_replace(F.regexp_replace(F.lower(X.strip_accents(F.col("t"))), "[^a-z0-9 ]+", " "), r"\s+", " "))
    hashed = F.sha1(F.concat(F.lit("|"), F.substring(F.coalesce(slow, F.lit("")), 1, 400)))
    got = df.select(X.fold_text(F.col("t")).eqNullSafe(slow).alias("a"), (X.content_hash(F.lit(""), F.col("t")) == hashed).alias("b")).collect()
    assert all(r["a"] and r["b"] for r in got)
    plan = df.select(X.tokens(F.col("t")), X.fold_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "array_contains" not in plan


def test_numeric_claims(spark):
    claim = lambda f, t: one(spark, X.numeric_claim(F.col("t"), f), t=t)
    assert claim("magnitude", "a magnitude 6,1 quake") == "6.1"
    assert claim("fatalities", "1,200 people killed") == "1200" == claim("fatalities", "1200 dead")
    assert claim("depth_km", "depth of 10 km") == "10"
    assert claim("injured", "nobody") is None


def test_attribution_stem(spark):
    assert one(spark, X.is_attributed(F.col("t")), t="o grupo reivindicou o ataque")
    assert not one(spark, X.is_attributed(F.col("t")), t="the attack happened")


def test_bots_and_hosts(spark):
    assert one(spark, X.is_bot(F.col("t")), t="Googlebot/2") and one(spark, X.is_bot(F.col("t")), t="") and one(spark, X.is_bot(F.lit(None).cast("string")))
    assert not one(spark, X.is_bot(F.col("t")), t="Mozilla/5.0")
    assert one(spark, X.url_host(F.col("t")), t="https://a.b/c?example.com") == "a.b"


def test_measures(spark):
    assert one(spark, M.clamp_score(F.col("v")), v=2.5) == 3 and one(spark, M.clamp_score(F.col("v")), v=-2.5) == 0 and one(spark, M.clamp_score(F.col("v")), v=200.0) == 100
    assert one(spark, M.clamp_score(F.lit(None).cast("double"))) is None
    assert one(spark, M.rounded(F.col("v")), v=-2.5) == -2
    assert one(spark, M.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == __import__("pytest").approx(6371 * 3.14159265, rel=1e-6)
    assert one(spark, M.saturating(F.lit(10_000))) == 60 and one(spark, M.saturating(F.lit(0))) == 0


def test_freshness(spark):
    at = F.to_timestamp(F.lit("2024-01-01 02:00:00"))
    state = lambda c, as_of: one(spark, M.freshness(F.lit(c), at, F.to_timestamp(F.lit(as_of))))
    assert state("natural_events", "2024-01-01 04:00:00") == "RECENT" and state("science", "2024-01-01 04:00:00") == "FRESH"
    assert state("natural_events", "2024-02-01 00:00:00") == "EXPIRED" and state("anything", "2023-01-01 00:00:00") == "FRESH"
    assert one(spark, M.relative_age(at, F.to_timestamp(F.lit("2024-01-03 03:00:00")))) == "2 d"


def test_claims_are_whole_words_and_numbers(spark):
    claim = lambda f, t: one(spark, X.numeric_claim(F.col("t"), f), t=t)
    assert claim("magnitude", "M6.5, Mag. 7") == "6.5" and claim("magnitude", "item 5 ham 3") is None
    assert claim("fatalities", "12 Vítimas  mortais") == "12" and claim("fatalities", "3,450 deaths") == "3450" and claim("fatalities", "5 deadlines") is None
    assert claim("depth_km", "depth 10 km, then depth 12 km") == "10" and claim("depth_km", "depth 10 kmh") is None
    assert claim("injured", "2,5 injured") == "2.5" and claim("injured", "1,234,567 wounded") == "1234567"
