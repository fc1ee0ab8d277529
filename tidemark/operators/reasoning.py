"""Reasoning without a model: the lines that signals, stances and sources give, each with its section and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import fixed

ROW = ["symbol", "section", "ord", "line"]
#: Lines of supporting and undecided signals among inferences, and of undecided ones among counter-evidence.
SUPPORTING, UNDECIDED, DOUBTS = 4, 2, 3


def _lines(rows: DataFrame, found: list[tuple[Column, str, Column | int, Column]]) -> DataFrame:
    """(symbol, section, ord, line): for each row the lines whose condition holds."""
    one = [
        F.when(c, F.struct(F.lit(section).alias("section"), (F.lit(o) if isinstance(o, int) else o).cast("int").alias("ord"), line.alias("line")))
        for c, section, o, line in found
    ]
    return rows.select("symbol", F.explode(F.array_compact(F.array(*one))).alias("f")).select("symbol", "f.*")


def weighed(signals: DataFrame, stances: DataFrame) -> DataFrame:
    """Signals with `net`, the heavier side, their `part` in it (supporting, opposing, undecided) and place `k` among those."""
    net = F.when(F.col("bull_weight") > F.col("bear_weight"), "bull").when(F.col("bear_weight") > F.col("bull_weight"), "bear").otherwise("neutral")
    x = signals.join(stances.select("symbol", net.alias("net")), "symbol")
    part = F.when(F.col("side") == "neutral", "undecided").when(F.col("net") == F.col("side"), "supporting").when(F.col("net") != "neutral", "opposing")
    x = x.withColumn("part", part)
    return x.withColumn("k", F.row_number().over(Window.partitionBy("symbol", "part").orderBy("ord", "rule")))


def narrative(signals: DataFrame, stances: DataFrame, confidences: DataFrame, evidence: DataFrame, metrics: DataFrame) -> DataFrame:
    """(symbol, section, ord, line) of the sections judgment, facts, inferences, counter_evidence and observations.

    evidence: completed rows (symbol, ordinal, label, evidence_id, is_fallback); confidences: (symbol, confidence);
    metrics: (symbol, fear_greed). A symbol without signals has its general lines alone."""
    x = weighed(signals, stances)
    name = F.concat("data_type", F.lit(" rule "), "rule")
    is_a = lambda part, most=None: (F.col("part") == part) & (F.lit(True) if most is None else F.col("k") <= most)
    of_signals = _lines(x, [
        (is_a("supporting", SUPPORTING), "inferences", F.col("k"), F.concat(name, F.lit(" points to "), "net")),
        (is_a("undecided", UNDECIDED), "inferences", F.col("k") + 10, F.concat(name, F.lit(" gives no direction"))),
        (is_a("opposing"), "counter_evidence", F.col("k"), F.concat(name, F.lit(" points to "), "side")),
        (is_a("undecided", DOUBTS), "counter_evidence", F.col("k") + 100, F.concat(name, F.lit(" is undecided"))),
        (is_a("opposing", 1), "observations", 1, F.concat(F.lit("whether "), name, F.lit(" grows stronger"))),
    ])
    count = lambda part: F.count(F.when(F.col("part") == part, 1)).alias(part)
    counts = x.groupBy("symbol").agg(count("supporting"), count("opposing"), count("undecided"), F.first("net").alias("net"))
    base = stances.select("symbol").join(counts, "symbol", "left").join(confidences.select("symbol", "confidence"), "symbol", "left")
    base = base.join(metrics.select("symbol", "fear_greed"), "symbol", "left").fillna({"supporting": 0, "opposing": 0, "undecided": 0, "net": "neutral"})
    text = lambda c: F.col(c).cast("string")
    sided = F.col("net") != "neutral"
    of_symbols = _lines(base, [
        (F.lit(True), "judgment", 1, F.concat("symbol", F.lit(" leans "), "net", F.lit(": "), text("supporting"), F.lit(" signals for it, "), text("opposing"), F.lit(" against"))),
        ((F.col("supporting") == 0) & (F.col("undecided") == 0), "inferences", 20, F.lit("no signal gives a direction")),
        (F.col("opposing") > 0, "inferences", 30, F.concat(text("opposing"), F.lit(" signals oppose this; confidence "), fixed("confidence", 2))),
        (sided & (F.col("opposing") == 0), "counter_evidence", 200, F.concat(F.lit("nothing opposes; that "), text("supporting"), F.lit(" signals agree proves no cause"))),
        (F.lit(True), "counter_evidence", 400, F.lit("weighed by rules, not checked by a model")),
        (sided, "observations", 2, F.concat(F.lit("whether price and volume of the next day go on "), "net")),
        (F.col("fear_greed").isNotNull(), "observations", 3, F.concat(F.lit("whether fear and greed leave "), fixed("fear_greed", 1))),
        (F.lit(True), "observations", 4, F.lit("whether announcements and chain activity go with the price")),
    ])
    state = F.when(F.col("is_fallback"), " is unavailable").otherwise(" was observed")
    of_sources = _lines(evidence, [
        (F.lit(True), "facts", F.col("ordinal"), F.concat("evidence_id", F.lit(": "), "label", state)),
        (F.col("is_fallback"), "counter_evidence", F.col("ordinal") + 300, F.concat("label", F.lit(" has no live data, so nothing from there can oppose"))),
    ])
    return of_signals.unionByName(of_symbols).unionByName(of_sources).select(*ROW)


def by_data_type(evidence: DataFrame, types: list[str], value: str = "evidence_id") -> DataFrame:
    """(symbol, a column per type): `value` of the first row of each data type, null where a symbol has none.

    evidence: (symbol, ordinal, data_type, value); ties of ordinal go to the smaller value."""
    first = [F.min_by(value, F.when(F.col("data_type") == t, F.struct("ordinal", value))).alias(t) for t in types]
    return evidence.groupBy("symbol").agg(*first)


def footnotes(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (symbol, evidence_id, ...) with `number`, the place of that record in its symbol's list from 1; null if unknown."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("ordinal", "evidence_id"))
    return citations.join(evidence.select("symbol", "evidence_id", place.cast("int").alias("number")), ["symbol", "evidence_id"], "left")


def shown_indicators(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, indicator, value): the named scalar metrics as text, in their order; nulls are left out."""
    each = F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).cast("string").alias("value")) for n in names])
    return metrics.select("symbol", F.explode(each).alias("i")).select("symbol", "i.*").where("value is not null")


def run_state(steps: DataFrame) -> DataFrame:
    """(symbol, state, degraded): `clean` if no source of a run had a fallback or was skipped, else `degraded`."""
    bad = F.count(F.when(F.coalesce("is_fallback", F.lit(True)), 1))
    return steps.groupBy("symbol").agg(F.when(bad == 0, "clean").otherwise("degraded").alias("state"), bad.alias("degraded"))
