"""Intermediate results as Parquet in the folder that driver and executors share.

A staged table cuts lineage and survives the loss of any executor, since a later read goes to the
shared folder and not to an executor's memory or disk."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import delete, new_path

__all__ = ["by_ids", "in_batches", "new_path", "release", "shuffles_dropped", "stage", "tasks", "text_last", "whole_rows"]


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes `df` once and returns a DataFrame that reads it back. `options` go to the Parquet writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Deletes the files of staged tables that no later plan reads."""
    for df in frames:
        files = df.inputFiles()
        if files:
            delete(df.sparkSession, files[0].rpartition("/")[0])


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of every write within as soon as it ends, and not when the driver's memory is next cleared."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


#: Bytes of rows that go to a Python worker at a time, so that long texts need bounded memory there and in the JVM.
BATCH_BYTES = 8 << 20


def _giving_back(batches, function):
    yield from function(batches)
    pa.default_memory_pool().release_unused()  # workers stay for later tasks


def in_batches(df: DataFrame, function, schema) -> DataFrame:
    """`df.mapInArrow` in batches of about BATCH_BYTES or of one row; the session keeps that setting."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(partial(_giving_back, function=function), schema)


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row): each row as one struct, so that no column name of `docs` can clash with what is added to it."""
    return docs.select(F.struct("*").alias("row"))


def text_last(batches):
    """Batches of `whole_rows` with the text as a last column, which shares the struct's memory."""
    for batch in batches:
        rows = batch.column(0)
        yield pa.RecordBatch.from_arrays([rows, rows.field("text")], names=["row", "_text"])


#: Ids that a join may send to every task, about 16 bytes each there.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """`df` left_semi or left_anti joined with `ids`, a staged table of one long id column that both have.

    Up to BROADCAST_IDS rows of ids are counted and broadcast, so that long texts stay where they are; more are shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, ids.columns[0], how)


def tasks(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session has; the cluster's operator sizes it with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
