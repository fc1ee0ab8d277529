"""Small intermediate tables that several parts of a query read: written once, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Paths written within each `scratch` that is open.
_OPEN: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where the session names no folder and tasks share the driver's machine, one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root and not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return (root or _OWN[0]).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    for held in _OPEN:
        held.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back, so that it is computed once."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged within it. A query's result reads staged tables, so it is written or collected inside."""
    held: list[str] = []
    _OPEN.append(held)
    try:
        yield
    finally:
        _OPEN.remove(held)
        for path in held:
            delete(spark, path)
