"""Queries over long series, which are scanned in blocks, and their SQL: the recurrences, bar after bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd
from tidemark.operators import scan
from tidemark.plans import oracle
from tidemark.sources.tables import event_sums, read, region_bars


def q_scan_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Averages and index over one series of all events by the minute."""
    events = read(spark, sf, "events").withColumn("event_type", F.lit("all"))
    bars = scan.numbered(event_sums(events, 1), ["bar"])
    x = scan.smoothed(bars, {"ema12": scan.ema("close", 12), "ema144": scan.ema("close", 144)}, rsi=6)
    return x.select("bar", *[rnd(c, 4).alias(c) for c in ("ema12", "ema144", "rsi")])


def q_scan_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The ribbon strategy over daily bars in blocks of 128."""
    x = scan.strategy(region_bars(spark, sf), oversold=40.0, overbought=60.0, vol_mult=1.0, size=128)
    return x.select("symbol", "bar", "trend", "in_tunnel", "volume_spike", F.coalesce("signal", F.lit("-")).alias("signal"))


def q_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's place in the series of its type."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id")
    return scan.numbered(e, ["ts", "event_id"]).select("symbol", "event_id", "idx")


QUERIES = {"scan_minutes": q_scan_minutes, "scan_signals": q_scan_signals, "scan_ticks": q_ticks}

ORACLE_SQL = {
    "scan_minutes": oracle.ORACLE_SQL["minute_series"],
    "scan_signals": oracle.ORACLE_SQL["strategy_signals"],
    "scan_ticks": "SELECT event_type AS symbol, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events",
}
