"""Queries of rules that are rows of a table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.plans import oracle
from tidemark.plans.catalogue import measured
from tidemark.sources.tables import read


def q_signals(spark: SparkSession, sf: str) -> DataFrame:
    return rules.fired(measured(spark, sf), rules.built_in(spark)).withColumn("weight", F.col("weight").cast("double"))


def q_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as metrics, and parts as rules: a range of prices and, for every second part, a status."""
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), "o_totalprice", "o_orderstatus")
    part = read(spark, sf, "part").select(
        (F.col("p_partkey") % 5).cast("int").alias("ord"), F.concat(F.lit("p"), "p_partkey").alias("rule"), F.lit("orders").alias("data_type"),
        F.lit("bull").alias("side"), (F.col("p_size") / 100).cast("decimal(6,2)").alias("weight"), ((F.col("p_partkey") * 97) % 400_000).cast("double").alias("low"), "p_size", "p_partkey",
    )
    head = ["ord", "rule", "data_type", "side", "weight"]
    none = lambda kind: F.lit(None).cast(kind)
    price = part.select(*head, F.lit(0).alias("part"), F.lit("o_totalprice").alias("metric"), "low", F.lit(True).alias("low_in"), (F.col("low") + 10 * F.col("p_size")).alias("high"), F.lit(False).alias("high_in"), none("string").alias("text"))
    status = part.where("p_partkey % 2 = 0").select(*head, F.lit(1).alias("part"), F.lit("o_orderstatus").alias("metric"), none("double").alias("low"), F.lit(False).alias("low_in"), none("double").alias("high"), F.lit(False).alias("high_in"), F.lit("F").alias("text"))
    return rules.fired(orders, price.unionAll(status)).select("symbol", "rule", "ord", F.col("weight").cast("double").alias("weight"))


QUERIES = {"signal_rules": q_signals, "rule_table": q_parts}

ORACLE_SQL = {
    "signal_rules": oracle.ORACLE_SQL["signal_inventory"],
    "rule_table": """WITH p AS (SELECT *, (p_partkey * 97) % 400000 AS low FROM part)
SELECT o_orderkey AS symbol, 'p' || p_partkey AS rule, (p_partkey % 5)::INT AS ord, p_size / 100.0::DOUBLE AS weight
FROM orders JOIN p ON o_totalprice >= low AND o_totalprice < low + 10 * p_size AND (p_partkey % 2 = 1 OR o_orderstatus = 'F')""",
}
