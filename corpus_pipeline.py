"""From documents to packed training sequences: five stages, each a written table.

``STAGES`` names them in order; each function takes (spark, docs, sf_dir) and
works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import decontaminate, jaccard_join, langid, packing, pii
from runweave.llm.shared import discard, small_batches, table, written


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language: texts without letters or unlike every profile go.

    What is unlike is set by the labelled documents that were not learned from: all
    but 0.2 % of these are like enough to their best profile.
    """
    small_batches(spark)
    held_out = F.coalesce(langid.is_held_out(F.col("doc_id")), F.lit(False))
    profiles = langid.learn(docs.filter(~held_out))
    return langid.keep_known(docs, profiles, min_score=langid.cut_off(docs.filter(held_out), profiles))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest identifier of each group linked by 5-word shingle similarity of 0.8 or more."""
    small_batches(spark)
    return jaccard_join.keep_one(docs, size=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out of every text the words that lie in a benchmark phrase."""
    small_batches(spark)
    return _sized(decontaminate.cut_leaks(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind."""
    return _sized(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 tokens: one row per piece."""
    small_batches(spark)
    return packing.pieces_digest(packing.pack_documents(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Language profiles and tokenization cannot be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)  # a table of this run, which nothing reads any more
    return STAGES[-1][1](spark, docs, sf_dir)
