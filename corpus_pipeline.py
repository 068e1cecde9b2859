"""A pipeline over documents: toxicity, quality, near-duplicates, mixture, tokens. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, mixing, quality, simhash, toxicity
from textloom.llm.common import fresh_dir, remove_dir, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic; it is fitted on the labels of sf_dir."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def remove_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group's robust estimate."""
    return quality.passing(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    return bpe.default_round_trip(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality", remove_low_quality),
    ("near_duplicates", remove_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's rows written as Parquet in the shared folder and read again. A stage's folder goes when the next stage is written; the last one's rows stay, as they are the result.

    Each stage keeps all columns of documents whatever their names, and works on rows: nulls in any column, empty texts, repeated rows and repeated or null doc_ids are judged row by row, as the
    operators' modules say. An empty table gives no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return docs


#: Toxicity, robust estimates and fingerprints are not expressible in SQL; tests/llm compares the stages with brute-force versions on a small table.
ORACLE_SQL = None
