"""Stored postings: search by a table of questions reads the buckets of their terms and no text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_text, tokens
from ..operators.windows import top_n
from ..saved import saved
from ..sources.stored import StoredTable

#: Rows of the index: what one document has in one bucket, its terms in one string and their frequencies beside it.
WORDS = "part long, doc_id long, length int, at timestamp, terms string, tfs array<int>"
GRAMS = "part long, doc_id long, field string, at timestamp, grams array<string>"
VALUES = "doc_id long, field string, value string"


class _Lists(StoredTable):
    """Rows of an index bucketed by a hash of their terms: a lookup reads the buckets of its terms, one row a term and document."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int, each: list[Column]):
        super().__init__(spark, path, schema, ["part", *keys], by="part")
        self.parts, self.each = buckets, each

    def lookup_by(self, some: DataFrame) -> DataFrame:
        (name,) = some.columns
        wanted = some.distinct()
        rows = super().lookup_by(wanted.select(_part(F.col(name), self.parts).alias("part")))
        return rows.select(*self.each).join(wanted, name, "left_semi")


class Postings:
    """Words of texts with their frequency and the text's length (P9), and three-letter runs of short fields.

    Both are bucketed by term, and a document has one row in each bucket that its terms fall in. A batch adds documents
    that the index doesn't have; fields are titles and places, whose values are kept once, which is where a hit is verified.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.parts = spark, buckets
        word = F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))).alias("term", "tf")
        self.words = _Lists(spark, f"{path}/words", WORDS, ["doc_id"], buckets, [F.col("doc_id"), F.col("length"), F.col("at"), word])
        self.grams = _Lists(spark, f"{path}/grams", GRAMS, ["doc_id", "field"], buckets, [F.col("doc_id"), F.col("field"), F.col("at"), F.explode("grams").alias("gram")])
        self.values = StoredTable(spark, f"{path}/values", VALUES, ["doc_id", "field"], buckets)

    def add(self, batch: int, docs: DataFrame, fields: tuple[str, ...] = ()) -> None:
        """docs: (doc_id, at), `text` where words are wanted, and the fields. Null texts and fields have no postings; a doc_id stands for one document."""
        if "text" in docs.columns:
            words = F.filter(F.split(fold_text(F.col("text")), " "), lambda w: w != "")
            each = docs.filter("text is not null").select("doc_id", "at", words.alias("w")).select("doc_id", "at", F.size("w").cast("int").alias("length"), F.explode(_by_part(F.col("w"), self.parts)).alias("p"))
            each = each.select("p.part", "doc_id", "length", "at", F.array_join("p.items.term", " ").alias("terms"), F.col("p.items.tf").alias("tfs"))
            self.words.upsert(batch, each)
        if fields:
            values = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("value")) for f in fields])
            runs = docs.select("doc_id", "at", F.explode(values).alias("f")).select("doc_id", "at", "f.field", "f.value").filter("value <> ''")
            self.values.upsert(batch, runs.select("doc_id", "field", "value"))
            each = runs.select("doc_id", "field", "at", F.explode(_by_part(_runs(), self.parts)).alias("p"))
            self.grams.upsert(batch, each.select("p.part", "doc_id", "field", "at", F.col("p.items.term").alias("grams")))

    def ranked(self, questions: DataFrame, most: int = 40) -> DataFrame:
        """(query_id, doc_id, tf, rank): for each question (query_id, q) the documents that hold all its terms, best first.

        The rank is that of search_ranked: summed frequency over the square root of the length; ties go to the id.
        """
        asked = saved(questions.select("query_id", F.array_distinct(tokens(F.col("q"))).alias("terms")).filter("size(terms) > 0").select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term")))
        hits = asked.join(self.words.lookup_by(asked.select("term")), "term")
        full = hits.groupBy("query_id", "n", "doc_id", "length").agg(F.count("*").alias("held"), F.sum("tf").cast("long").alias("tf")).filter("held = n")
        full = full.withColumn("rank", F.floor(F.col("tf") * 1_000_000 / F.sqrt("length")).cast("long"))
        return top_n(full, ["query_id"], [F.desc("rank"), F.asc("doc_id")], most).select("query_id", "doc_id", "tf", "rank")

    def containing(self, questions: DataFrame, most: int = 40) -> DataFrame:
        """(query_id, doc_id): for each question (two characters at least) the newest documents one of whose fields contains it.

        Questions meet fields by their first run of three characters, or by both where they have two.
        """
        needle = F.lower(F.trim("q"))
        asked = saved(questions.select("query_id", needle.alias("needle")).filter("length(needle) >= 2").withColumn("gram", F.substring("needle", 1, 3)))
        near = asked.join(self.grams.lookup_by(asked.select("gram")), "gram").join(self.values.read(), ["doc_id", "field"])
        hits = near.filter(F.col("value").contains(F.col("needle")))
        return top_n(hits.groupBy("query_id", "doc_id").agg(F.max("at").alias("at")), ["query_id"], [F.desc_nulls_last("at"), F.asc("doc_id")], most).select("query_id", "doc_id")


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("long")


def _by_part(terms: Column, parts: int) -> Column:
    """(part, items) of an array of terms: items are (term, tf), each distinct term once with its count, in one pass over the sorted terms."""

    def cut(items: Column, change: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column]) -> Column:
        """make(first place, number of items) of each run of items, which begins where `change` says so."""
        n = F.size(items)
        starts = F.filter(F.transform(items, lambda _, i: i), lambda i: (i == 0) | change(F.get(items, i), F.get(items, i - 1)))
        return _with(starts, lambda s: F.transform(s, lambda i, k: make(i, F.coalesce(F.get(s, k + 1), n) - i)))

    def counted(w: Column) -> Column:
        return cut(w, lambda a, b: a != b, lambda i, n: F.struct(F.get(w, i)["part"].alias("part"), F.get(w, i)["term"].alias("term"), n.cast("int").alias("tf")))

    def dealt(c: Column) -> Column:
        return cut(c, lambda a, b: a["part"] != b["part"], lambda i, n: F.struct(F.get(c, i)["part"].alias("part"), F.slice(c, i + 1, n).alias("items")))

    ordered = F.sort_array(F.transform(terms, lambda t: F.struct(_part(t, parts).alias("part"), t.alias("term"))))
    return _with(_with(ordered, counted), dealt)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _runs() -> Column:
    """Distinct runs of two and of three characters of `value`."""

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length("value") - n + 1)
        return F.when(F.length("value") >= n, F.transform(at, lambda i: F.substring(F.col("value"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(2), of(3)))
