"""A corpus pipeline of five stages over `documents`: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import jaccard, packing, pii, quality, substrings
from tidewater.llm.common import if_small, saved, shared_dir

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps; those without a doc_id can't be judged by it and stay."""
    scores = quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = scores.groupBy("doc_id").agg(F.max("keep").alias("keep")).filter("not keep").select("doc_id")
    return docs.join(if_small(saved(rejected)), "doc_id", "left_anti").select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    found = jaccard.jaccard_components(docs)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(if_small(saved(gone)), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows of an earlier document go; documents of which nothing is left go too."""
    out = substrings.remove_repeats(docs)
    out = out.filter(~(F.col("text").rlike(r"^[\x20\x09-\x0D]*$")) | F.col("text").isNull())
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("pii", personal_data),
    ("packing", pack),
]

#: A trained classifier and boosted trees take part; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
