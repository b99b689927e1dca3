"""The corpus pipeline: toxicity, n-gram Jaccard join, PII, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Null, empty, repeated and clashing inputs are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import bpe, mixing, ngram_join, pii, toxicity
from skyloom.llm.langid import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of four folds of five."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accept(docs, toxicity.fit(docs, labels.filter(fold("doc_id", 5) != 0)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a five-word Jaccard similarity of 0.8 or more the one with the smallest
    id (of equal ids the smaller hash of the text; no id comes last); documents without words stay. Documents are told
    apart by a 64-bit hash of id and text, so different texts of one id are different documents, and of rows that
    repeat both one stays."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    keyed = docs.withColumn("__key", key)
    found = ngram_join.similar_components(keyed.select("__key", "text"), "__key", n=5, percent=80).select("__key", "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(F.coalesce("text", F.lit(""))), "__key")).alias("first")
    names = keyed.groupBy("__key").agg(first)
    known = found.join(names, "__key")
    best = known.groupBy("component_id").agg(F.min("first").alias("best"))  # a large group is no group of one task
    gone = known.join(best, "component_id").filter("first <> best").select("__key")
    once = Window.partitionBy("__key").orderBy(*[F.col(c).asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")])
    kept = keyed.join(gone, "__key", "left_anti").withColumn("__place", F.row_number().over(once)).filter("__place = 1")
    return kept.select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources to equal weight, as many documents as there are, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document, a row a copy."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and byte-pair merges have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
