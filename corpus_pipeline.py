"""The training-data pipeline: five stages over documents, each written and reread by the next.

ORACLE_SQL is None: SQL can express neither the similarity join nor the encoder; the tests
hold every stage against a brute-force version of it instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.llm import bpe, decontam, neardup, quality, suffixdedup
from prismata.session import drop_materialized, materialize, scratch

#: Bytes from which a repeated passage goes: less than fifty words of any of the languages.
PASSAGE = 208

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that occur elsewhere."""
    return suffixdedup.strip(docs, PASSAGE).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of ids and decoded bytes."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and reread before the next, and its scratch tables and its input are deleted."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as tables:
            docs = tables.keep(materialize(stage(spark, before, sf_dir), "pipeline"))
        if k:
            drop_materialized(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
