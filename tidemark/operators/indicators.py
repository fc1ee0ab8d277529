"""Time-series indicators over bars (symbol, bar, idx, close, ...), as windows that end at the current bar.

All share the partitioning by symbol in order of idx, so one shuffle and sort serves a chain of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numbers import pct_change, rnd

WINDOWS = [("14d", 14), ("90d", 90), ("365d", 365), ("full", None)]


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("idx")


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: Bars of a block in which powers of a ratio are summed; of the lengths that fit a ratio the longest is taken.
BLOCKS = (128, 2048, 32_768, 524_288)


def _block(ratio: float) -> int:
    """Longest block whose powers of `ratio` stay within 1e250, for values up to 1e50; what is two blocks back then weighs below 1e-31."""
    fits = [n for n in BLOCKS if -math.log(ratio) * n <= 250 * math.log(10)]
    return fits[-1] if fits else 8


def smoothed(x: str, period: int, ratio: float, first: int = 0) -> Column:
    """Running y = ratio * y + (1 - ratio) * x from idx first + period on, seeded there-1 with the mean of the first `period` values.

    For series of any length: sums of column x over powers of the ratio run within blocks of bars and start
    anew in each, and a block takes over what the two before it come to; anything older weighs less than a
    double resolves. Null before the seed, and from the first null value on. Series of one call of
    withColumns whose blocks are equally long share their windows."""
    at, seat = f"(idx - {first})", period - 1
    if period == 1 or ratio <= 0:
        return F.expr(f"CASE WHEN {at} >= {seat} THEN {x} END")
    block = _block(ratio)
    if -math.log(ratio) * block < 35:
        raise ValueError(f"a period of {period} reaches back over more than two blocks; operators.scan takes any")
    start = f"({at} - pmod({at}, {block}))"
    power = lambda n: f"power({ratio!r}D, {n})"
    weighed = f"CASE WHEN {at} < 0 THEN NULL WHEN {at} <= {seat} THEN {x} / {period} ELSE {1 - ratio!r}D * {x} END"
    decay = f"({start} - greatest({at}, {seat}))"
    missing = f"count_if({at} >= 0 AND {x} IS NULL)"
    own = f"OVER (PARTITION BY symbol, {start} ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    back = lambda lo, hi: f"OVER (PARTITION BY symbol ORDER BY {start} RANGE BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"
    last, before = (f"coalesce(sum({weighed} * {power(f'{decay} + {block}')}) {back(n * block, n * block)}, 0D)" for n in (1, 2))
    value = f"{power(f'{at} - {start}')} * ({last} + {power(block)} * {before} + sum({weighed} * {power(decay)}) {own})"
    known = f"{missing} {own} + {missing} {back('UNBOUNDED', block)} = 0"
    return F.expr(f"CASE WHEN {at} >= {seat} AND {known} THEN {value} END")


def ema(column: str, period: int) -> Column:
    return smoothed(column, period, 1 - 2 / (period + 1))


def wilder(gains: str, losses: str, period: int) -> tuple[Column, Column]:
    """Wilder's averages of two columns of moves, known from bar 1 on."""
    q = (period - 1) / period
    return smoothed(gains, period, q, 1), smoothed(losses, period, q, 1)


def moves(bars: DataFrame) -> DataFrame:
    """`bars` with _up and _down: how far each close is above or below the one before."""
    step = F.col("close") - F.lag("close").over(by_symbol())
    known = bars.withColumn("_step", step)
    return known.withColumns({"_up": F.expr("greatest(_step, 0D)"), "_down": F.expr("greatest(-_step, 0D)")}).drop("_step")


def relative_strength(gain: str, loss: str) -> Column:
    """100 without losses, else 0 without gains, null while warming up."""
    return F.expr(f"CASE WHEN {gain} IS NULL THEN NULL WHEN {loss} = 0 THEN 100D WHEN {gain} = 0 THEN 0D ELSE 100 - 100 / (1 + {gain} / {loss}) END")


def wilder_rsi(bars: DataFrame, period: int = 6, out: str = "rsi") -> DataFrame:
    """`bars` with Wilder's relative strength index."""
    gain, loss = wilder("_up", "_down", period)
    known = moves(bars).withColumns({"_g": gain, "_l": loss})
    return known.withColumn(out, relative_strength("_g", "_l")).drop("_up", "_down", "_g", "_l")


def crossed_over(x: str, level: float) -> Column:
    return F.coalesce((F.lag(x).over(by_symbol()) < level) & (F.col(x) >= level), F.lit(False))


def crossed_under(x: str, level: float) -> Column:
    return F.coalesce((F.lag(x).over(by_symbol()) > level) & (F.col(x) <= level), F.lit(False))


def returns(bars: DataFrame) -> DataFrame:
    """`bars` with ret: simple return on the bar before, null for the first and after a zero close."""
    return bars.withColumn("ret", F.try_divide("close", F.lag("close").over(by_symbol())) - 1)


def windowed(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    """Each bar once for each lookback window it is in, `label`led; windows are the last n bars, None all.

    The set of windows is fixed, so the rows grow by at most its size."""
    late = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("idx")))
    ranked = bars.withColumn("_late", late)
    labels = F.array_compact(
        F.array(*[F.when(F.col("_late") <= n, F.lit(w)) if n else F.lit(w) for w, n in windows])
    )
    return ranked.withColumn("label", F.explode(labels)).drop("_late")


def price_windows(bars: DataFrame, windows=WINDOWS) -> DataFrame:
    """One row per symbol and lookback window of at least two bars.

    (symbol, label, days, date_start, date_end, start_price, end_price, return_pct, volatility_annualised_pct,
    max_drawdown_pct, low, high, percentile_in_range). Volatility is of the window's own returns, by their
    sample deviation; a peak of zero has no drawdown; a flat window has no percentile."""
    own = Window.partitionBy("symbol", "label").orderBy("idx")
    rows = windowed(bars, windows).withColumns(
        {
            "_ret": F.try_divide("close", F.lag("close").over(own)) - 1,
            "_peak": F.max("close").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    last, first = F.max_by("close", "idx"), F.min_by("close", "idx")
    low, high = F.min("close"), F.max("close")
    deviation = F.when(F.count("_ret") >= 2, F.stddev_samp("_ret"))
    fall = F.min(F.try_divide(F.col("close") - F.col("_peak"), F.col("_peak")))
    return (
        rows.groupBy("symbol", "label")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.min("bar").alias("date_start"),
            F.max("bar").alias("date_end"),
            first.alias("start_price"),
            last.alias("end_price"),
            pct_change(last, first).alias("return_pct"),
            rnd(deviation * math.sqrt(365) * 100, 2).alias("volatility_annualised_pct"),
            rnd(F.least(F.lit(0.0), F.coalesce(fall, F.lit(0.0))) * 100, 2).alias("max_drawdown_pct"),
            low.alias("low"),
            high.alias("high"),
            rnd(F.try_divide(last - low, high - low) * 100, 1).alias("percentile_in_range"),
        )
        .where("days >= 2")
    )


def downsample(bars: DataFrame, points: int = 260) -> DataFrame:
    """At most `points` bars of each symbol, evenly spaced, both ends kept."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    # row i is kept if it is round_half_even(k * (n - 1) / (points - 1)) for some k
    sized = bars.withColumn("_n", n)
    near = F.floor(F.col("idx") * (points - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    at = [F.rint((near + d) * (F.col("_n") - 1) / F.lit(points - 1)) for d in (-1, 0, 1)]
    inside = [(near + d).between(0, points - 1) for d in (-1, 0, 1)]
    hit = (at[0] == F.col("idx")) & inside[0] | (at[1] == F.col("idx")) & inside[1] | (at[2] == F.col("idx")) & inside[2]
    return sized.where((F.col("_n") <= points) | hit).drop("_n")
