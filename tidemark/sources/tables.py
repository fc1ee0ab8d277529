"""Tables of an input directory, and price bars made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(bars: DataFrame) -> DataFrame:
    """`idx` from 0 by time within each symbol."""
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("bar")) - 1)


def event_sums(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(symbol, bar, open, high, low, close, volume, n) of events by type and time bucket, not numbered.

    Open and close belong to the first and last event by (ts, event_id). One shuffle of partial bars."""
    when = F.struct("ts", "event_id")
    out = events.groupBy(F.col("event_type").alias("symbol"), F.window("ts", f"{minutes} minutes").alias("w")).agg(
        rnd(F.min_by("value", when), 4).alias("open"),
        rnd(F.max("value"), 4).alias("high"),
        rnd(F.min("value"), 4).alias("low"),
        rnd(F.max_by("value", when), 4).alias("close"),
        rnd(F.sum("value"), 4).alias("volume"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("bar", F.date_format("w.start", "yyyy-MM-dd HH:mm")).drop("w")


def event_bars(events: DataFrame, minutes: int = 30) -> DataFrame:
    """`event_sums` with idx."""
    return numbered(event_sums(events, minutes))


def region_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, bar, open, high, low, close, volume, n, idx): daily unit prices of line items by supplier region.

    Line items of a day have no order, so open and close are the day's mean. The dimensions are small."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    price = F.try_divide("l_extendedprice", "l_quantity")
    day = line.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("r_name").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("bar")
    )
    out = day.agg(
        rnd(F.avg(price), 4).alias("close"),
        rnd(F.max(price), 4).alias("high"),
        rnd(F.min(price), 4).alias("low"),
        rnd(F.sum("l_quantity"), 4).alias("volume"),
        F.count(F.lit(1)).alias("n"),
    )
    return numbered(out.withColumn("open", F.col("close")))


class BadBars(ValueError):
    """A price file that cannot be used."""


REQUIRED = ["date", "open", "high", "low", "close", "volume"]


def read_ohlcv_csv(spark: SparkSession, path: str, symbol: str | None = None, days: int | None = 14) -> DataFrame:
    """Daily bars of CSV files with a header, the last `days` of each file's symbol (all if None or 0).

    Columns beyond the required ones are ignored, a byte-order mark before the header is tolerated, values
    that are no numbers are null. A missing column is an error, and so are fewer than two rows."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    missing = [c for c in REQUIRED if c not in names]
    if missing:
        raise BadBars(f"missing columns: {', '.join(missing)}")
    numbers = [F.expr(f"try_cast(`{names[c]}` AS double)").alias(c) for c in REQUIRED[1:]]
    who = F.lit(symbol.strip().upper()) if symbol else F.upper(F.regexp_extract(F.input_file_name(), r"([^/_]+)[^/]*$", 1))
    bars = raw.select(who.alias("symbol"), F.col(f"`{names['date']}`").alias("bar"), *numbers)
    if bars.limit(2).count() < 2:
        raise BadBars("fewer than two rows")
    return tail(bars, days) if days else numbered(bars)


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol, numbered from 0 again."""
    late = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar")))
    return numbered(bars.withColumn("_late", late).where(F.col("_late") <= n).drop("_late"))
