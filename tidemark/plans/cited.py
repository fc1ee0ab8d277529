"""Queries of citations and mentions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import citing
from tidemark.sources.tables import read

#: Records of a report, and how many reports there are.
RECORDS, REPORTS = 12, 7


def q_linked(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as lines of reports that cite records, at their start, in brackets, and ids that others begin with."""
    line = """CASE turn % 4 WHEN 0 THEN concat(' [EV-', conv_id % 12 + 1, '] : ', text) WHEN 1 THEN concat('EV-', turn % 12 + 1, '：', text, ' see [EV-1] and EV-12.')
        WHEN 2 THEN concat(text, ' (EV-11, [EV-2],EV-13)') ELSE text END"""
    c = read(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % REPORTS).alias("report"), F.expr(line).alias("line"))
    records = spark.range(REPORTS).select(F.col("id").alias("report"), F.explode(F.sequence(F.lit(1), F.lit(RECORDS))).alias("number"))
    records = records.withColumn("evidence_id", F.concat(F.lit("EV-"), "number"))
    return citing.linkify(c, records, "report", "line").select("conv_id", "turn", F.col("linked").alias("line"))


def q_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have any of the slices of benchmark items, in any case."""
    slices = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.expr("lower(text)").substr(k * 7, F.lit(4) + k))
    aliases = read(spark, sf, "benchmark").select(F.explode(slices).alias("alias"))
    return citing.alias_mentions(read(spark, sf, "documents"), aliases, "doc_id", "text")


QUERIES = {"linked_lines": q_linked, "alias_mentions": q_aliases}

_IDS = "|".join(f"EV-{n}" for n in range(RECORDS, 0, -1))


def _linked(x: str) -> str:
    for n in range(RECORDS, 0, -1):
        x = f"regexp_replace({x}, '\\[?EV-{n}\\]?', '[^{n}]', 'g')"
    return x


ORACLE_SQL = {
    "linked_lines": f"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' [EV-' || (conv_id % 12 + 1) || '] : ' || text WHEN 1 THEN 'EV-' || (turn % 12 + 1) || '：' || text || ' see [EV-1] and EV-12.'
    WHEN 2 THEN text || ' (EV-11, [EV-2],EV-13)' ELSE text END AS line FROM conversations),
d AS (SELECT *, regexp_replace(coalesce(line, ''), '^\\s+|\\s+$', '', 'g') AS t FROM c),
e AS (SELECT *, regexp_extract(t, '^\\[?({_IDS})\\]?\\s*[:：]\\s*', 1) AS first, regexp_replace(t, '^\\[?({_IDS})\\]?\\s*[:：]\\s*', '') AS rest FROM d)
SELECT conv_id, turn, {_linked("rest")} || CASE WHEN first <> '' THEN '[^' || substr(first, 4) || ']' ELSE '' END AS line FROM e""",
    "alias_mentions": """WITH a AS (SELECT DISTINCT substr(lower(text), k * 7, 4 + k) AS alias FROM benchmark, range(1, 9) t(k))
SELECT doc_id, alias FROM documents JOIN a ON alias <> '' AND contains(lower(text), alias)""",
}
