"""Overlapping and gap-based windows over events, on a table or on a stream under a watermark.

On a stream a window is emitted once, in append mode, when the watermark (the latest time seen less `late`) has passed its
end; rows that are older than the watermark of the batch before are dropped by then. On a table all windows are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sliding(events: DataFrame, length: str = "60 minutes", slide: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """(symbol, start, end, n, total, low, high) of events (ts, event_type, value) in each window that they are in.

    Windows begin at multiples of `slide` since 1970 and overlap; each event counts in length / slide of them, so partial
    sums are made before the shuffle. Events without a time are in no window; null values count in n alone."""
    w = F.window("ts", length, slide)
    out = _timed(events, late).groupBy(w.alias("w"), F.col("event_type").alias("symbol")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"), rnd(F.min("value"), 4).alias("low"), rnd(F.max("value"), 4).alias("high")
    )
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "low", "high")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, total, kinds) of each user's events (ts, user_id, value, event_type) that follow within `gap`.

    start is the first event's time and end the last one's plus the gap; an event at a session's end begins no new one.
    Events without a time are in no session; a null user is a user of its own."""
    s = F.session_window("ts", gap)
    out = _timed(events, late).groupBy(s.alias("s"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")
    )
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total", "kinds")


def run(spark: SparkSession, windows, source: str, out: str, checkpoint: str, **options) -> None:
    """Applies `sliding` or `sessions` to what event files `source` has that were not read before, appends the windows that
    are complete to `out` as Parquet, and stops; a next call goes on."""
    events = spark.readStream.schema(EVENTS).parquet(source)
    query = windows(events, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
