"""Price bars from a stream of events. Indicators stay batch: their windows reach back to a symbol's first bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd


def stream_bars(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """(symbol, start, open, high, low, close, volume, n) of a stream (event_id, ts, event_type, value).

    A bar is final, and emitted once in append mode, when the watermark passes its end; later events are dropped."""
    when = F.struct("ts", "event_id")
    bars = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"), F.col("event_type").alias("symbol"))
        .agg(
            rnd(F.min_by("value", when), 4).alias("open"),
            rnd(F.max("value"), 4).alias("high"),
            rnd(F.min("value"), 4).alias("low"),
            rnd(F.max_by("value", when), 4).alias("close"),
            rnd(F.sum("value"), 4).alias("volume"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "n")


def run_bars(spark: SparkSession, source: str, out: str, checkpoint: str, minutes: int = 30, late: str = "1 hour"):
    """Reads what event files `source` has now, appends final bars to `out` as Parquet, and stops; a next call goes on."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).parquet(source)
    query = stream_bars(events, minutes, late).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start(out)
