"""What a run leaves behind: evidence and bars as files, reports as text, one folder or file set per symbol.

A run that is repeated leaves what it left before: it replaces the folders of the symbols that it has, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evidence import keep_newest
from tidemark.sources.shared import staged

#: Fixed value: snapshots that a coin's ledger keeps.
KEPT = 30


def _replacing(df: DataFrame, by: str):
    """A writer that replaces the folders of the values of `by` that `df` has; a large one is written by several tasks."""
    return df.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)


def write_evidence(evidence: DataFrame, path: str) -> None:
    _replacing(evidence, "coin").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Markdown texts of (symbol, report), a folder per symbol."""
    _replacing(reports.select("symbol", F.col("report").alias("value")), "symbol").text(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as CSV with a header, a folder per symbol, beside a manifest of rows and dates."""
    columns = [F.col("bar").alias("date"), "open", "high", "low", "close", "volume"]
    _replacing(bars.select("symbol", *columns), "symbol").option("header", True).csv(f"{path}/bars")
    _replacing(manifest(bars), "symbol").json(f"{path}/manifest")


def manifest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("bar").alias("first"), F.max("bar").alias("last"))


LEDGER = "label string, balance double, fetched_at string, coin string"


def store_snapshots(ledger: DataFrame, path: str, most: int = KEPT) -> None:
    """Adds balance snapshots (coin, fetched_at, label, balance) to the stored ledger, which keeps the newest `most` of a coin.

    A snapshot of a time that is stored replaces it, so a repeated call changes nothing. Only the coins that `ledger` has
    are read and written again. What is written is staged first: a lost job leaves the old folders as they were."""
    spark = ledger.sparkSession
    new = staged(ledger.select("label", "balance", "fetched_at", "coin"), "new-snapshots")
    new.limit(0).write.mode("append").partitionBy("coin").parquet(path)  # the folder is there on the first call too
    coins = new.select("coin").distinct()
    held = spark.read.schema(LEDGER).parquet(path).join(F.broadcast(coins), "coin", "left_semi").select(new.columns)
    kept = held.join(new.select("coin", "fetched_at").distinct(), ["coin", "fetched_at"], "left_anti").select(new.columns)
    newest = keep_newest(kept.unionAll(new), most)
    _replacing(staged(newest.select(new.columns), "stored-snapshots"), "coin").parquet(path)


def store_batches(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream's micro-batches to folders `batch=<id>`: a batch that runs again after a failure replaces its folder."""

    def store(batch: DataFrame, number: int) -> None:
        _replacing(batch.withColumn("batch", F.lit(number)), "batch").parquet(path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
