"""Queries that run a stream over the tables, to its end and from its checkpoint again, and their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd
from tidemark.plans.oracle import r
from tidemark.sources.shared import new_path
from tidemark.sources.tables import read
from tidemark.streaming import ledger, windows


def in_three(e: DataFrame) -> list[DataFrame]:
    """Events of the first, second and last third of the days."""
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return [e]
    day = first.replace(hour=0, minute=0, second=0, microsecond=0)
    cuts = [day + timedelta(days=k * ((last - day).days // 3 + 1)) for k in range(4)]
    return [e.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))) for a, b in zip(cuts, cuts[1:])]


def q_ledger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Daily balances by event type and wallet, compared on arrival; the stream stops and goes on after each third of the days."""
    root = new_path(spark, "ledger")
    for part in in_three(read(spark, sf, "events")):
        balances = part.groupBy(
            F.col("event_type").alias("coin"), F.date_format("ts", "yyyy-MM-dd").alias("fetched_at"), F.concat(F.lit("w"), F.col("user_id") % 7).alias("label")
        ).agg(rnd(F.sum("value"), 4).alias("balance"))
        whole = F.map_from_entries(F.collect_list(F.struct("label", "balance"))).alias("balances")
        balances.groupBy("coin", "fetched_at").agg(whole).write.mode("append").parquet(f"{root}/snapshots")
        ledger.run_ledger(spark, f"{root}/snapshots", f"{root}/deltas", f"{root}/checkpoint")
    return spark.read.schema(ledger.DELTA).parquet(f"{root}/deltas")


def streamed(windowed, spark: SparkSession, sf: str) -> DataFrame:
    """The windows that are complete by the end of a stream of events, which stops and goes on after each third of the days."""
    root = new_path(spark, windowed.__name__)
    events = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in in_three(events):
        part.select(*[c.split()[0] for c in windows.EVENTS.split(", ")]).write.mode("append").parquet(f"{root}/events")
        windows.run(spark, windowed, f"{root}/events", f"{root}/windows", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/windows")


def in_text(found: DataFrame) -> DataFrame:
    """Windows with their ends as text, start_at and end_at."""
    ends = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f"{c}_at") for c in ("start", "end")]
    return found.select(*ends, *[c for c in found.columns if c not in ("start", "end")])


QUERIES = {
    "ledger_stream": q_ledger_stream,
    "sliding_windows": lambda s, d: in_text(windows.sliding(read(s, d, "events"))),
    "session_windows": lambda s, d: in_text(windows.sessions(read(s, d, "events"))),
    "sliding_stream": lambda s, d: in_text(streamed(windows.sliding, s, d)),
    "session_stream": lambda s, d: in_text(streamed(windows.sessions, s, d)),
}

SLIDING = f"""w AS (SELECT event_type AS symbol, time_bucket(INTERVAL '20 minutes', ts) - k * INTERVAL '20 minutes' AS start, value FROM events, range(3) t(k)),
x AS (SELECT symbol, start, start + INTERVAL '60 minutes' AS "end", count(*) AS n, {r("sum(value)", 4)} AS total, {r("min(value)", 4)} AS low, {r("max(value)", 4)} AS high FROM w GROUP BY ALL)"""
SESSIONS = f"""b AS (SELECT *, coalesce((ts > lag(ts) OVER w + INTERVAL '6 hours')::INT, 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM b),
x AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n, {r("sum(value)", 4)} AS total, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds
  FROM c GROUP BY user_id, k)"""
TEXT = """SELECT strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start_at, strftime("end", '%Y-%m-%d %H:%M:%S.%f') AS end_at, * EXCLUDE (start, "end") FROM x"""
DONE = "WHERE \"end\" <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '1 hour' FROM events)"

ORACLE_SQL = {
    "ledger_stream": f"""WITH l AS (SELECT event_type AS coin, strftime(ts, '%Y-%m-%d') AS fetched_at, 'w' || (user_id % 7) AS label, {r("sum(value)", 4)} AS balance FROM events GROUP BY 1, 2, 3),
s AS (SELECT coin, fetched_at, list(label) AS labels, row_number() OVER (PARTITION BY coin ORDER BY fetched_at) AS k FROM l GROUP BY 1, 2),
p AS (SELECT s.coin, s.fetched_at, max(b.fetched_at) AS previous_at FROM s JOIN s b ON b.coin = s.coin AND b.k BETWEEN s.k - 30 AND s.k - 1 AND list_has_any(s.labels, b.labels) GROUP BY 1, 2)
SELECT l.coin, l.fetched_at, l.label, l.balance, previous_at, b.balance AS previous, {r("l.balance - b.balance", 4)} AS delta
FROM l LEFT JOIN p USING (coin, fetched_at) LEFT JOIN l b ON b.coin = l.coin AND b.label = l.label AND b.fetched_at = previous_at""",
    "sliding_windows": f"WITH {SLIDING} {TEXT}",
    "session_windows": f"WITH {SESSIONS} {TEXT}",
    "sliding_stream": f"WITH {SLIDING} {TEXT} {DONE}",
    "session_stream": f"WITH {SESSIONS} {TEXT} {DONE}",
}
