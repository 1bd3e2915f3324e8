"""Document fingerprints: a Merkle tree over spans, paragraphs and sections, by built-in functions only.

Leaves are spans of at most eight words that don't cross a paragraph's end; a paragraph (text between line
feeds) hashes its leaves, a section hashes its paragraphs, and the root hashes the sections. A section ends with a
paragraph whose hash says so (one in eight), so what is put in or taken out changes the section that it is in and no
later one. A fingerprint is the text `root;section,section,...;leaf:chars,leaf:chars|leaf:chars,...`, with a bar
between paragraphs: equal roots mean equal texts, sections and then paragraphs that the other text doesn't have tell
where an edit lies, and shared leaves tell how much two texts have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN_WORDS = 8
#: First characters of paragraphs' hashes that end a section: two of sixteen.
ENDS_SECTION = "08"
#: Bytes of text in a range of doc_id, and ranges at most.
RANGE_BYTES, MOST_RANGES = 32 << 20, 4096


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of the column `text` as `out`; null counts as empty."""
    span = r"(?:[^ ]*+ ){0,%d}+[^ ]*+(?: |$)" % (SPAN_WORDS - 1)

    def leaves(paragraph: Column) -> Column:
        spans = F.filter(F.regexp_extract_all(paragraph, F.lit(span), F.lit(0)), lambda s: s != "")
        return F.transform(spans, lambda s: F.concat(F.substring(F.sha2(s, 256), 1, 12), F.lit(":"), F.length(s).cast("string")))

    # one column a level, so that no level is computed twice
    names = [f"_{out}_{x}" for x in ("leaves", "paragraphs", "sections")]
    df = df.withColumn(names[0], F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda p: F.array_join(leaves(p), ",")))
    df = df.withColumn(names[1], F.transform(names[0], lambda p: F.sha2(p, 256)))
    ended = F.array_join(F.transform(names[1], lambda p: F.concat(p, F.when(F.substring(p, 1, 1).isin(*ENDS_SECTION), "|").otherwise(","))), "")
    df = df.withColumn(names[2], F.transform(F.filter(F.split(ended, r"\|"), lambda s: s != ""), lambda s: F.sha2(s, 256)))
    short = F.transform(names[2], lambda s: F.substring(s, 1, 16))
    return df.withColumn(out, F.concat_ws(";", F.sha2(F.array_join(names[2], ","), 256), F.array_join(short, ","), F.array_join(names[0], "|"))).drop(*names)


def root(print_: Column) -> Column:
    return F.substring_index(print_, ";", 1)


def likeness(a: Column, b: Column) -> Column:
    """Characters in shared leaves over characters in all distinct leaves of two fingerprints; 1 where the roots agree."""

    def leaf_set(p: Column) -> Column:
        return F.filter(F.array_distinct(F.split(F.replace(F.substring_index(p, ";", -1), F.lit("|"), F.lit(",")), ",")), lambda x: x != "")

    def chars(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda t, x: t + F.substring_index(x, ":", -1).cast("long"))

    left, right = leaf_set(a), leaf_set(b)
    both, all_ = chars(F.array_intersect(left, right)), chars(F.array_union(left, right))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.coalesce(both.cast("double") / F.nullif(all_, F.lit(0)), F.lit(0.0)))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of those sections of b that a doesn't have."""

    def sections(p: Column) -> Column:
        return F.split(F.substring_index(F.substring_index(p, ";", 2), ";", -1), ",")

    return _missing(sections(a), sections(b))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of those paragraphs of b that a doesn't have; they lie in the sections that it doesn't have."""

    def paragraphs(p: Column) -> Column:
        return F.split(F.substring_index(p, ";", -1), r"\|", -1)

    return _missing(paragraphs(a), paragraphs(b))


def _missing(left: Column, right: Column) -> Column:
    """Places in `right` of what `left` doesn't have. The fold carries the difference, so that it is formed once."""
    start = F.struct(F.array_except(right, left).alias("new"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        at = F.when(F.array_contains(a["new"], x), F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"])
        return F.struct(a["new"].alias("new"), at.alias("at"), (a["i"] + 1).alias("i"))

    return F.aggregate(right, start, step, lambda a: a["at"])


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs (doc_id, text; no null text) with next_text: the text of the next row by doc_id, then text; after the last, the first.

    Rows are dealt into ranges of doc_id, as many as the bytes of text ask for (RANGE_BYTES each, but a few for each
    task at least), whose bounds come from quantiles over all rows. Each range looks ahead by itself; only the first
    row of each range crosses to the range before. Null doc_ids come first.
    """
    n = partitions
    if not n:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = min(MOST_RANGES, max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    docs = docs.withColumn("_part", _range_of(F.col("doc_id"), cuts)).withColumn("_key", F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("id")))
    first = docs.groupBy("_part").agg(F.min("_key").alias("_key"))  # one row per range, so it may be broadcast
    first = docs.drop("_part").join(F.broadcast(first), "_key").groupBy("_part").agg(F.min("text").alias("_first"))
    order = Window.orderBy("_part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = first.select("_part", F.coalesce(F.lead("_first").over(order), F.first("_first").over(whole)).alias("_ahead"))
    within = Window.partitionBy("_part").orderBy("_key", "text")
    looked = docs.withColumn("_next", F.lead("text").over(within)).join(ahead, "_part", "left")
    return looked.withColumn("next_text", F.coalesce("_next", "_ahead")).drop("_key", "_part", "_next", "_ahead")


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most doc_id: first by every so manieth cut, then by those between; 0 for null."""

    def below(xs: Column) -> Column:
        return F.size(F.filter(xs, lambda c: c <= doc_id))

    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    step = max(1, int(len(cuts) ** 0.5))
    coarse = below(literal(cuts[step - 1 :: step]))
    groups = F.array(*[literal(cuts[i : i + step]) for i in range(0, len(cuts) + 1, step)])
    return F.when(doc_id.isNull(), 0).otherwise(coarse * step + F.coalesce(below(F.get(groups, coarse)), F.lit(0)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections, edited_paragraphs.

    The last two number what the edited text has and the text hasn't. The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next document. Null texts are empty; repeated rows and equal doc_ids are documents of their own, in the
    order of their texts; other columns are left out; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = with_next(docs)
    n = F.length("text")
    tail = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    d = d.withColumns({"n_chars": n.cast("long"), "edited": edited})
    d = with_fingerprint(with_fingerprint(d, "text", "fingerprint"), "next_text", "next_fingerprint")
    d = with_fingerprint(d.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint")
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        differing_sections(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_sections"),
        differing_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_paragraphs"),
    )


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
