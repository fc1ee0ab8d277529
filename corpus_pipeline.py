"""A corpus pipeline over documents: quality, language, near-duplicates, packing.

Each stage is written as Parquet in the folder that the cluster shares and read again by the next, so a
lost executor never costs more than the stage that runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.langid import language_filter
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_filter
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.llm.staging import stage
from tidemark.llm.tables import read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of those outside fold 0, scores 0.3 or more."""
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a known language which at least half of their letters are in."""
    return language_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: No SQL: a trained classifier, a tokenizer and a packing plan are not expressible; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; the rows of the last."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
