"""Weighted signal rules as data, and what is reduced from them: stance, drivers, confidence, risks, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, rnd

#: Fixed values: (order, rule, source, condition on the symbol's metrics, side, weight).
RULES = [
    (1, "1a", "market", "return_pct > 2", "bull", 1.0),
    (1, "1b", "market", "return_pct < -2", "bear", 1.0),
    (1, "1c", "market", "return_pct between -2 and 2", "neutral", 0.5),
    (2, "2a", "vegas_channel", "trend = 'bullish_aligned'", "bull", 1.2),
    (2, "2b", "vegas_channel", "trend = 'bearish_aligned'", "bear", 1.2),
    (3, "3", "vegas_channel", "not aligned", "neutral", 1.0),
    (4, "4a", "vegas_channel", "rsi > 80", "bear", 1.0),
    (4, "4b", "vegas_channel", "rsi < 20", "bull", 1.0),
    (5, "5", "vegas_channel", "volume_spike", "neutral", 0.8),
    (6, "6a", "derivatives", "funding_bias = 'long_crowded'", "bear", 1.1),
    (6, "6b", "derivatives", "funding_bias = 'short_crowded'", "bull", 1.1),
    (6, "6c", "derivatives", "funding_bias = 'balanced'", "neutral", 0.5),
    (7, "7a", "long_short_ratio", "ratio_bias = 'long_dominant'", "bear", 0.9),
    (7, "7b", "long_short_ratio", "ratio_bias = 'short_dominant'", "bull", 0.9),
    (8, "8a", "social", "sentiment = 'positive'", "bull", 0.4),
    (8, "8b", "social", "sentiment = 'negative'", "bear", 0.4),
    (9, "9a", "macro", "fear_greed <= 25", "bull", 0.9),
    (9, "9b", "macro", "fear_greed >= 75", "bear", 0.9),
    (9, "9c", "macro", "fear_greed > 25 and fear_greed < 75", "neutral", 0.5),
    (10, "10a", "macro", "risk_appetite = 'deteriorating'", "bear", 0.8),
    (10, "10b", "macro", "risk_appetite = 'improving'", "bull", 0.8),
    (11, "11", "announcement", "announcements > 0", "neutral", 0.4),
    (12, "12a", "tvl", "change_30d is not null and tvl_direction = 'expanding'", "bull", 0.7),
    (12, "12b", "tvl", "change_30d is not null and tvl_direction = 'contracting'", "bear", 0.7),
    (12, "12c", "tvl", "change_30d is not null and tvl_direction not in ('expanding', 'contracting')", "neutral", 0.4),
]
LEAST_DIRECTIONAL, MARGIN = 1.5, 0.25


def signal_inventory(metrics: DataFrame) -> DataFrame:
    """(symbol, ord, rule, data_type, side, weight): the rules whose condition holds; a null metric fires none."""
    fired = [
        F.when(
            F.expr(cond),
            F.struct(
                F.lit(o).alias("ord"), F.lit(r).alias("rule"), F.lit(d).alias("data_type"), F.lit(s).alias("side"),
                F.lit(w).cast("decimal(6,2)").alias("weight"),
            ),
        )
        for o, r, d, cond, s, w in RULES
    ]
    return metrics.select("symbol", F.explode(F.array_compact(F.array(*fired))).alias("s")).select("symbol", "s.*")


def stance(signals: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, stance, bull_weight, bear_weight, net_margin_pct, signal_count) of every symbol, also those without signals."""
    weight = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("weight"))), F.lit(0)).cast("double")
    sums = symbols.select("symbol").distinct().join(signals, "symbol", "left").groupBy("symbol").agg(
        rnd(weight("bull"), 2).alias("bull_weight"), rnd(weight("bear"), 2).alias("bear_weight"), F.count("side").alias("signal_count")
    )
    total = rnd(F.col("bull_weight") + F.col("bear_weight"), 2)
    margin = F.coalesce(F.try_divide(F.col("bull_weight") - F.col("bear_weight"), total), F.lit(0.0))
    side = (
        F.when(total < LEAST_DIRECTIONAL, "neutral").when(margin >= MARGIN, "bullish").when(margin <= -MARGIN, "bearish").otherwise("neutral")
    )
    return sums.withColumns({"stance": side, "net_margin_pct": rnd(margin * 100, 1)})


def rollup(signals: DataFrame) -> DataFrame:
    """(symbol, side, data_type, level, signals, weight): counts and weights by symbol, side and source, by symbol and side, by
    side and source, by side, and of all, in one pass. `level` has a bit for each column that a row is summed over: 4 symbol,
    2 side, 1 data_type."""
    sets = [("symbol", "side", "data_type"), ("symbol", "side"), ("side", "data_type"), ("side",), ()]
    names = ("symbol", "side", "data_type")
    x = signals.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    weight = F.coalesce(F.sum("weight"), F.lit(0)).cast("double")
    return x.agg(F.grouping_id(*names).alias("level"), F.count(F.lit(1)).alias("signals"), rnd(weight, 2).alias("weight"))


def drivers(signals: DataFrame, stances: DataFrame, most: int = 3) -> DataFrame:
    """(symbol, rank, rule, weight): heaviest signals of the stance's side, ties in rule order; none for neutral."""
    side = F.when(F.col("stance") == "bullish", "bull").when(F.col("stance") == "bearish", "bear")
    own = signals.join(stances.select("symbol", side.alias("_side")), "symbol").where("side = _side")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("weight"), "ord", "rule"))
    return own.withColumn("rank", rank).where(F.col("rank") <= most).select("symbol", "rank", "rule", F.col("weight").cast("double").alias("weight"))


def confidence(stances: DataFrame, failures: DataFrame) -> DataFrame:
    """(symbol, source_failures, confidence); failures: (symbol, is_fallback) rows."""
    lost = failures.groupBy("symbol").agg(F.count(F.when(F.col("is_fallback"), 1)).alias("source_failures"))
    total = F.col("bull_weight") + F.col("bear_weight")
    agreement = F.coalesce(F.try_divide(F.greatest("bull_weight", "bear_weight"), total), F.lit(0.0))
    x = stances.join(lost, "symbol", "left").withColumn("source_failures", F.coalesce("source_failures", F.lit(0)))
    raw = 0.30 + 0.35 * agreement - 0.06 * F.col("source_failures")
    return x.select("symbol", "source_failures", rnd(clamp(raw, 0.20, 0.85), 2).alias("confidence"))


def risk_factors(metrics: DataFrame, stances: DataFrame, failures: DataFrame, policy: DataFrame) -> DataFrame:
    """(symbol, ord, factor): one per degraded source, then those of the data, then two that always hold.

    policy: (symbol, policy_status); a symbol without a status has no such factor."""
    lost = failures.where("is_fallback").select("symbol", F.lit(1).alias("ord"), F.concat(F.lit("degraded source: "), "label").alias("factor"))
    ratio = F.try_divide("bull_weight", "bear_weight")
    x = metrics.join(stances, "symbol").join(policy.select("symbol", "policy_status"), "symbol", "left")
    rules = [
        (2, "bull and bear weights are close", (F.col("bull_weight") > 0) & ratio.between(0.6, 1.67)),
        (3, "timeframes disagree", ~F.col("aligned")),
        (4, "positioning is unstable", F.col("consistency_pct") < 60),
        (5, "policy releases are unavailable", F.col("policy_status").startswith("unavailable")),
        (6, "signals are simultaneous, not causal", F.lit(True)),
        (7, "social and news sources are less reliable", F.lit(True)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(o).alias("ord"), F.lit(t).alias("factor"))) for o, t, c in rules]))
    return lost.unionByName(x.select("symbol", F.explode(found).alias("f")).select("symbol", "f.ord", "f.factor"))


CRITIQUE = "verdict string, summary string, confidence_adjustment double, findings array<struct<severity: string, claim: string, evidence_id: string>>"


def audited(critiques: DataFrame, known: DataFrame) -> DataFrame:
    """(id, accepted, reason, confidence, adjusted) of critiques (id, confidence, body).

    A body that is no JSON of the schema, an unknown verdict, an adjustment outside [-1, 0] or a finding
    about an unknown evidence id rejects it whole and leaves the confidence as it was."""
    x = critiques.withColumn("c", F.from_json("body", CRITIQUE))
    refs = x.select("id", F.explode("c.findings").alias("f")).select("id", F.col("f.evidence_id").alias("evidence_id"))
    refs = refs.where(~F.coalesce("evidence_id", F.lit("")).isin("", "N/A"))
    bad = refs.join(known.select("evidence_id").distinct(), "evidence_id", "left_anti").select("id").distinct().withColumn("_bad", F.lit(True))
    reason = (
        F.when(F.col("c.verdict").isNull() | F.col("c.confidence_adjustment").isNull(), "not of the schema")
        .when(~F.col("c.verdict").isin("supported", "weakened", "rejected"), "unknown verdict")
        .when(~F.col("c.confidence_adjustment").between(-1, 0), "adjustment out of range")
        .when(F.col("_bad"), "unknown evidence")
    )
    y = x.join(bad, "id", "left").withColumn("reason", reason)
    good = F.col("reason").isNull()
    new = rnd(clamp(F.col("confidence") + F.col("c.confidence_adjustment"), 0.0, 1.0), 4)
    return y.select("id", good.alias("accepted"), "reason", "confidence", F.when(good, new).otherwise(F.col("confidence")).alias("adjusted"))
