"""The order in which articles are fetched, and where a budget of fetched ones ends it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evidence import crawl_status
from tidemark.operators.scan import carried
from tidemark.sources.shared import staged

#: Fixed value: articles that one crawl fetches.
BUDGET = 8
#: Items of a list that one task counts; a list of any length is counted in blocks.
BLOCK = 4096


def statuses(allowed: list[str], error: str = "error") -> Column:
    """Why each item has its text or not, without a budget: `crawl_status`, with the name of the error that a fetch ended in."""
    status = crawl_status(allowed, "url", "robots", "body", "late")
    return F.when(status == "failed", F.concat_ws(":", F.lit("failed"), F.col(error))).otherwise(status)


def within_budget(items: DataFrame, key: str, order: str, status: str, budget: int = BUDGET) -> DataFrame:
    """`items` with `fetched_before` and `status`, null from the item on before which `budget` ones of its list were fetched.

    items: (key, order, status and any other columns); order is the place in the key's list, from 0, items without one last. A text that
    was read counts whether it was empty or not; what was skipped or failed does not. Items of equal order stand
    together in any order. A list's fetched items are counted in blocks of BLOCK places and the counts scanned, so one
    very long list is no single task."""
    last = items.agg(F.max(order)).first()[0] or 0
    block = F.coalesce(F.floor(F.col(order) / BLOCK), F.lit(last // BLOCK + 1))
    placed = items.withColumns({"_block": block, "_list": F.col(key), "_fetched": F.col(status).isin("ok", "empty").cast("long")})
    rows = staged(placed, "crawl")
    counts = staged(rows.groupBy(F.col("_list").alias("symbol"), "_block").agg(F.sum("_fetched").alias("n")), "crawl-counts")
    before = carried(counts, {"n": F.sum}).select(F.col("symbol").alias("_of"), F.col("_block").alias("_at"), F.col("n").alias("_carry"))
    found = rows.join(before, F.col("_list").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")), "left")
    own = F.sum("_fetched").over(Window.partitionBy("_list", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    total = (F.coalesce("_carry", F.lit(0)) + F.coalesce(own, F.lit(0))).cast("long")
    out = found.withColumn("fetched_before", total).withColumn(status, F.when(F.col("fetched_before") < budget, F.col(status)))
    return out.drop("_block", "_list", "_fetched", "_of", "_at", "_carry")
