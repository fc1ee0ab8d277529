"""Queries of crawls, of roll-ups and of what repeated runs leave behind, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd
from tidemark.operators import crawl, signals
from tidemark.plans import oracle, sinks
from tidemark.plans.catalogue import completed, inventory
from tidemark.plans.oracle import r
from tidemark.sources.shared import new_path, staged
from tidemark.sources.tables import read, region_bars

#: Hosts that may be read.
ALLOWED = ["example.com", "example.org"]


def q_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as articles of four lists: some late, some refused by robots, some failing, some empty."""
    url = F.regexp_replace("url", "//[^/?#]*(example[.][a-z]+)", "//www.$1").alias("url")
    p = read(spark, sf, "pages").select("page_id", url, (F.col("page_id") % 4).alias("list"), F.floor(F.col("page_id") / 4).alias("place"))
    known = {
        "late": F.col("page_id") % 23 == 0,
        "robots": F.when(F.col("page_id") % 19 != 0, F.col("page_id") % 13 != 0),
        "body": F.when(F.col("page_id") % 5 != 0, F.when(F.col("page_id") % 3 == 0, "  ").otherwise("text")),
        "error": F.when(F.col("page_id") % 10 == 0, "HTTPError").otherwise("TimeoutError"),
    }
    x = p.withColumns(known).withColumn("status", crawl.statuses(ALLOWED))
    found = crawl.within_budget(x, "list", "place", "status")
    return found.select("page_id", "list", "place", F.coalesce("status", F.lit("-")).alias("status"), "fetched_before")


def q_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return signals.rollup(inventory(spark, sf))


def q_stored_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Completed evidence written as JSON, the first region's a second time with other reliabilities, and read again."""
    path = new_path(spark, "evidence")
    found = staged(completed(spark, sf).withColumnRenamed("symbol", "coin"), "evidence")
    first = found.agg(F.min("coin")).first()[0]
    again = found.where(F.col("coin") == first).withColumn("reliability", F.lit(0.5))
    for rows in (found, again, again):
        sinks.write_evidence(rows, path)
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return spark.read.schema(", ".join(f"{c} {k}" for c, k in kinds.items())).json(path).select("coin", "label", "evidence_id", "reliability", "is_fallback")


def q_stored_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars written twice as CSV and read again: rows, first and last day and mean close of each symbol."""
    path = new_path(spark, "bars")
    bars = staged(region_bars(spark, sf), "bars")
    for _ in range(2):
        sinks.write_bars(bars, path)
    got = spark.read.option("header", True).schema("date string, open double, high double, low double, close double, volume double, symbol string").csv(f"{path}/bars")
    facts = spark.read.schema("rows long, first string, last string, symbol string").json(f"{path}/manifest")
    return got.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("close"), 2).alias("close")).join(facts, "symbol").select("symbol", "n", "close", F.col("first").alias("first_day"), F.col("last").alias("last_day"), F.col("rows").alias("listed"))


def q_stored_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Balances by hour stored in two halves that overlap, the second one twice: the newest 30 snapshots of each coin."""
    path = new_path(spark, "stored")
    e = read(spark, sf, "events")
    hours = staged(e.groupBy(
        F.col("event_type").alias("coin"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("fetched_at"), F.concat(F.lit("w"), F.col("user_id") % 7).alias("label")
    ).agg(rnd(F.sum("value"), 4).alias("balance")), "hours")
    for part in ("fetched_at < '2024-01-20'", "fetched_at >= '2024-01-10'", "fetched_at >= '2024-01-10'"):
        sinks.store_snapshots(hours.where(part), path)
    return spark.read.schema(sinks.LEDGER).parquet(path)


QUERIES = {
    "crawl_budget": q_crawl,
    "signal_rollup": q_rollup,
    "stored_evidence": q_stored_evidence,
    "stored_bars": q_stored_bars,
    "stored_ledger": q_stored_ledger,
}

ORACLE_SQL = {
    "crawl_budget": f"""WITH p AS (SELECT page_id, page_id % 4 AS list, page_id // 4 AS place, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*(example[.][a-z]+)', 1) AS host FROM pages),
s AS (SELECT *, CASE WHEN page_id % 23 = 0 THEN 'skipped:deadline' WHEN host NOT IN ({", ".join(f"'{h}'" for h in ALLOWED)}) THEN 'skipped:not_whitelisted'
  WHEN page_id % 19 = 0 OR page_id % 13 = 0 THEN 'skipped:robots' WHEN page_id % 5 = 0 THEN 'failed:' || CASE WHEN page_id % 10 = 0 THEN 'HTTPError' ELSE 'TimeoutError' END
  WHEN page_id % 3 = 0 THEN 'empty' ELSE 'ok' END AS status FROM p),
c AS (SELECT *, coalesce(sum((status IN ('ok', 'empty'))::INT) OVER (PARTITION BY list ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS fetched_before FROM s)
SELECT page_id, list, place, CASE WHEN fetched_before < 8 THEN status ELSE '-' END AS status, fetched_before FROM c""",
    "signal_rollup": f"""WITH RECURSIVE {oracle.REGION}, {oracle.METRICS}, {oracle.INVENTORY}
SELECT symbol, side, data_type, GROUPING(symbol, side, data_type)::BIGINT AS level, count(*) AS signals, {r("sum(weight)")} AS weight
FROM inv GROUP BY GROUPING SETS ((symbol, side, data_type), (symbol, side), (side, data_type), (side), ())""",
    "stored_evidence": f"""WITH RECURSIVE {oracle.COMPLETE} SELECT symbol AS coin, label, evidence_id, CASE WHEN symbol = (SELECT min(symbol) FROM comp) THEN 0.5 ELSE reliability END AS reliability, is_fallback FROM comp""",
    "stored_bars": f"""WITH RECURSIVE {oracle.REGION} SELECT symbol, count(*) AS n, {r("avg(close)")} AS close, min(bar) AS first_day, max(bar) AS last_day, count(*) AS listed FROM bars GROUP BY 1""",
    "stored_ledger": f"""WITH l AS (SELECT event_type AS coin, strftime(ts, '%Y-%m-%d %H') AS fetched_at, 'w' || (user_id % 7) AS label, {r("sum(value)", 4)} AS balance FROM events GROUP BY 1, 2, 3)
SELECT * FROM l QUALIFY dense_rank() OVER (PARTITION BY coin ORDER BY fetched_at DESC) <= 30""",
}
