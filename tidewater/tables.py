"""Views of the driver's tables as events, articles, sources, views and rules; each has the same text in SQL (queries/)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import article_id

#: Wall-clock of queries over orders and lineitem, and of those over events.
AS_OF, AS_OF_EVENTS = "2001-08-02 00:00:00", "2024-01-30 00:00:00"


def at(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times count as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    first = F.substring("o_orderpriority", 1, 1)
    category = F.when(first == "1", "war_conflict").when(first == "2", "natural_events").when(first == "3", "economy").when(first == "4", "politics").otherwise("unclassified")
    status = F.when(F.col("o_orderstatus") == "F", "PUBLISHED").when(F.col("o_orderstatus") == "O", "SUPERVISOR_REVIEW").otherwise("CLUSTERED")
    e = o.join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == c["c_custkey"]).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return e.select(
        F.col("o_orderkey").alias("event_id"), category.alias("category"), status.alias("status"), F.col("n_name").alias("country"), F.col("o_orderdate").alias("last_activity_at"),
        F.col("o_orderdate").alias("published_at"), F.concat(F.lit("Event "), F.col("o_orderkey").cast("string"), F.lit(" by "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_custkey").alias("owner_id"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, n = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    a = li.select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_partkey")
    a = a.join(s.select("s_suppkey", "s_nationkey"), a["l_suppkey"] == s["s_suppkey"]).join(n.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return a.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("published_at"), F.col("n_name").alias("geo_country"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "official").when(k % 4 == 1, "scientific").when(k % 4 == 2, "agency").otherwise("press")
    return read(spark, sf_dir, "supplier").select(
        k.alias("source_id"), F.col("s_name").alias("source_name"), F.col("s_nationkey").alias("publisher_group"), kind.alias("origin_type"), F.when(k % 10 != 9, 60 + k % 40).alias("reliability_score")
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.get_json_object("props", "$.k").cast("long").alias("event_id"), F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("is_bot"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") / 50).cast("int"))
    return e.select(F.col("user_id").alias("event_id"), F.col("event_type").alias("kind"), value.alias("value"), F.col("ts").alias("computed_at"), F.col("event_id").alias("id"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: the title is the first line cut to 200, the summary the whole text."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"), F.col("doc_id").alias("event_id"), F.col("source").alias("source_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 200).alias("title"), F.col("text").alias("summary"),
        F.concat(F.lit("http://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 420000000).alias("published_at"), "lang",
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    category = F.when(seg == "BUILDING", "war_conflict").when(seg == "MACHINERY", "natural_events").when(seg == "FURNITURE", "economy").when(seg == "HOUSEHOLD", "politics")
    return c.select(
        k.alias("user_id"), k.alias("rule_id"), F.concat(F.lit("rule "), k.cast("string")).alias("name"), category.alias("category"), F.when(k % 3 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("country"),
        F.when(k % 2 == 0, (40 + k % 50).cast("int")).alias("min_confidence"), F.when(k % 5 == 0, (50 + k % 40).cast("int")).alias("min_impact"), F.lit(None).cast("int").alias("min_relevance"),
        (k % 7 == 0).alias("only_verified"), (k % 11 != 0).alias("enabled"),
    )


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "category").when(k % 3 == 1, "country").otherwise("event")
    target = F.when(k % 3 == 0, F.when(k % 2 == 0, "economy").otherwise("politics")).when(k % 3 == 1, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).otherwise(k.cast("string"))
    return c.select(k.alias("user_id"), kind.alias("kind"), target.alias("target"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with coordinates by key arithmetic over the whole sphere, poles and date line among them."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 37) % 181 - 90).cast("double").alias("lat"), ((k * 101) % 361 - 180).cast("double").alias("lon"))


def feed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body"))


def with_article_id(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("article_key", article_id(F.col(url)))
