"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontamination, jaccard, language_id, packing, secrets
from tallyforge.llm.common import shared_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter, of no main language, or that fit none go. Decided by each row's own text: null ids and
    repeats are no exception, null texts go, all columns pass through, an empty table gives no rows."""
    return language_id.stage(spark, docs, sf_dir)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the smallest id, rows without one last. Repeated rows are one group, texts
    without words and null texts are alone, all columns pass through, an empty table gives no rows."""
    return jaccard.stage(spark, docs, sf_dir)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window stands go. A row is known by its id, null or not, and its text; null and empty texts stay, repeats go or stay
    alike, all columns pass through, an empty table gives no rows."""
    return decontamination.stage(spark, docs, sf_dir)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts become [SECRET] and n_chars is counted anew. Null and empty texts, ids and other columns stay as they are."""
    return secrets.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token sequences: a row per piece. Null and empty texts are the end id alone, null ids and repeats are kept, other columns go, an empty
    table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("packing", packed),
]

#: Language mixtures, the forest and token ids are beyond SQL; tests/llm/test_pipeline.py holds stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
