"""A training corpus from the documents: each stage works on all that the stage before it kept.

``STAGES`` are (name, function) pairs; a function takes ``(spark, docs, folder)`` and returns a DataFrame, which is
written as Parquet and read again as the documents of the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, linededup, packing, quality, simhash
from vacantia.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality.kept_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeated chunks and passages of over 50 words go, and documents left without a word; ``n_chars`` follows the text."""
    found = linededup.dedupe_passages(docs, words=50)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars.cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8 or more)."""
    return simhash.representatives(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The bucket, batch and position of each document."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: SQL has no XXH64, on which the near-duplicate stage rests; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order, over the documents of `folder`."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), name)
    return docs
