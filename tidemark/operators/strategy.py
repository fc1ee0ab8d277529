"""Ribbon strategy over bars: trend, tunnel, volume spikes and confirmed excursion signals.

Every column at a bar depends on bars up to it, so the value at a bar is what a replay of the series up
to that bar would give: one causal pass stands for a replay per bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd
from tidemark.operators.indicators import ema, moves, relative_strength, so_far, wilder

RIBBON = (144, 233, 377, 610, 987)
#: First bar a signal may stand at; a series must have as many bars.
WARMUP = 988


def _averages(periods) -> dict[str, Column]:
    return {f"ema{p}": ema("close", p) for p in periods}


def _ribbon_flags(bars: DataFrame, periods) -> DataFrame:
    """`bars` with ema<period> to those with bull and bear (strict order of all of them), tunnel and in_tunnel."""
    names = [f"ema{p}" for p in periods]
    ordered = lambda sign: " AND ".join(f"{a} {sign} {b}" for a, b in zip(names, names[1:]))
    out = bars.withColumns(
        {
            "bull": F.expr(f"coalesce({ordered('>')}, false)"),
            "bear": F.expr(f"coalesce({ordered('<')}, false)"),
            "tunnel_top": F.expr(f"CASE WHEN {names[0]} + {names[-1]} IS NOT NULL THEN greatest({names[0]}, {names[-1]}) END"),
            "tunnel_bottom": F.expr(f"CASE WHEN {names[0]} + {names[-1]} IS NOT NULL THEN least({names[0]}, {names[-1]}) END"),
        }
    )
    inside = " OR ".join(f"{c} BETWEEN tunnel_bottom AND tunnel_top" for c in ("close", "high", "low"))
    return out.withColumn("in_tunnel", F.expr(f"coalesce({inside}, false)"))


def _spike(multiple: float) -> Column:
    return F.expr(f"coalesce(volume > volume_ema * {multiple!r}D, false)")


def ribbon(bars: DataFrame, periods=RIBBON) -> DataFrame:
    """`bars` with the ribbon's averages, bull and bear (strict order of all of them), tunnel and in_tunnel."""
    return _ribbon_flags(bars.withColumns(_averages(periods)), periods)


def volume_spikes(bars: DataFrame, length: int = 144, multiple: float = 2.0) -> DataFrame:
    """`bars` with volume_ema and volume_spike; no spike while warming up."""
    return bars.withColumn("volume_ema", ema("volume", length)).withColumn("volume_spike", _spike(multiple))


def strategy(
    bars: DataFrame,
    rsi_len: int = 6,
    oversold: float = 20.0,
    overbought: float = 80.0,
    vol_len: int = 144,
    vol_mult: float = 2.0,
    periods=RIBBON,
    warmup: int = WARMUP,
) -> DataFrame:
    """`bars` with all indicators and `signal`, null where there is none and before bar `warmup`.

    A signal needs a volume spike within the run of bars beyond the level that ends at the bar before: the
    last spike is not before the bar where that run began. All averages are one projection, so they share
    their windows, and the rest are windows by symbol in order of idx."""
    gain, loss = wilder("_up", "_down", rsi_len)
    x = moves(bars).withColumns({**_averages(periods), "volume_ema": ema("volume", vol_len), "_g": gain, "_l": loss})
    x = states(x, periods, vol_mult, oversold, overbought)
    by, run = "OVER (PARTITION BY symbol ORDER BY idx)", "OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    x = x.withColumns({"_before": F.expr(f"lag(_zone) {by}"), "_rsi": F.expr(f"lag(rsi) {by}")})
    began, spiked = "CASE WHEN NOT _zone <=> _before THEN idx END", "CASE WHEN volume_spike THEN idx END"
    x = x.withColumns({"_began": F.expr(f"max({began}) {run}"), "_spike": F.expr(f"max({spiked}) {run}")})
    return signalled(x.withColumn("_was", F.expr(f"lag({CONFIRMED}) {by}")), oversold, overbought, warmup)


#: The zone of a run of bars beyond a level once a spike has been seen in it, else 0.
CONFIRMED = "CASE WHEN _spike >= _began THEN _zone ELSE 0 END"


def states(averages: DataFrame, periods, vol_mult: float, oversold: float, overbought: float) -> DataFrame:
    """Bars with their averages to those with rsi, volume_spike, ribbon and _zone: below the lower level, beyond the upper, or neither."""
    zone = f"CASE WHEN rsi < {oversold!r}D THEN -1 WHEN rsi > {overbought!r}D THEN 1 ELSE 0 END"
    x = averages.withColumns({"rsi": relative_strength("_g", "_l"), "volume_spike": _spike(vol_mult)})
    return _ribbon_flags(x, periods).withColumn("_zone", F.expr(zone))


def signalled(x: DataFrame, oversold: float, overbought: float, warmup: int) -> DataFrame:
    """States with what was one bar before (_rsi, _was) to those with trend and signal."""
    over, under = f"_rsi < {oversold!r}D AND rsi >= {oversold!r}D AND _was = -1", f"_rsi > {overbought!r}D AND rsi <= {overbought!r}D AND _was = 1"
    signal = f"""CASE WHEN {over} AND bull AND in_tunnel THEN 'bull_entry' WHEN {under} AND bear AND in_tunnel THEN 'bear_entry'
        WHEN {under} THEN 'take_profit_bull' WHEN {over} THEN 'take_profit_bear' END"""
    trend = "CASE WHEN bull THEN 'bullish_aligned' WHEN bear THEN 'bearish_aligned' ELSE 'mixed' END"
    out = x.withColumns({"trend": F.expr(trend), "_any": F.expr(signal)})
    out = out.withColumn("signal", F.expr(f"CASE WHEN idx >= {warmup} THEN _any END"))
    return out.drop("_up", "_down", "_g", "_l", "_zone", "_before", "_rsi", "_began", "_spike", "_was")


def latest(states: DataFrame, least: int = WARMUP) -> DataFrame:
    """One row per symbol of at least `least` bars: state at the last bar, last signal and bars since.

    The last signal is any of the series, also one before the first bar that may be traded."""
    seen = states.withColumns(
        {
            "last_signal": F.last("_any", ignorenulls=True).over(so_far()),
            "_at": F.last(F.when(F.col("_any").isNotNull(), F.col("idx")), ignorenulls=True).over(so_far()),
            "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
        }
    )
    return seen.where((F.col("idx") == F.col("_n") - 1) & (F.col("_n") >= least)).select(
        "symbol",
        "bar",
        "trend",
        rnd("tunnel_top", 4).alias("tunnel_top"),
        rnd("tunnel_bottom", 4).alias("tunnel_bottom"),
        "in_tunnel",
        rnd("rsi", 4).alias("rsi"),
        "volume_spike",
        "last_signal",
        (F.col("idx") - F.col("_at")).cast("int").alias("bars_since_signal"),
    )


def direction(trend: str) -> Column:
    return F.when(F.col(trend) == "bullish_aligned", "long").when(F.col(trend) == "bearish_aligned", "short").otherwise("neutral")


def alignment(higher: DataFrame, lower: DataFrame) -> DataFrame:
    """(symbol, higher_direction, lower_direction, passed) of two `latest` tables: both the same and not neutral."""
    h = higher.select("symbol", direction("trend").alias("higher_direction"))
    low = lower.select("symbol", direction("trend").alias("lower_direction"))
    same = (F.col("higher_direction") == F.col("lower_direction")) & (F.col("higher_direction") != "neutral")
    return h.join(low, "symbol").withColumn("passed", same)
