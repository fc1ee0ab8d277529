"""Indicators and the ribbon strategy over series of any length, as scans over blocks of bars.

A series is cut into blocks of equally many bars, and blocks, not symbols, are what windows are partitioned by. Each
block is summed up in one row; a scan over these rows gives what every block starts from; a second pass adds that to the
block's own bars. Averages take over the sums of as many blocks before as still weigh anything, counts and last places
those of all blocks before. So one symbol with all the bars spreads over the cluster as many short ones do.

`bars` have symbol, idx from 0 without gaps, and the columns that are read. Results are those of `indicators` and
`strategy`, which run each symbol in one task and suit series of some thousand bars."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators import strategy as ribbon_strategy
from tidemark.operators.indicators import relative_strength
from tidemark.sources.shared import staged

#: Bars of a block at most, and lengths of blocks in which powers of a ratio are summed.
LENGTHS = (8, 128, 2048, 32_768)
#: Blocks that are scanned as one group; a group's sum goes to every later group of its symbol.
GROUP = 256
#: Exponent below which what a bar leaves is not carried on: e ** -80 is below 1e-34.
FORGOTTEN = 80.0
#: Exponent that powers stay under, for values up to 1e50.
LARGEST = 250 * math.log(10)


class Average(NamedTuple):
    """y = ratio * y + (1 - ratio) * x from idx first + period - 1 on, where it is the mean of the first `period` values."""

    x: str
    period: int
    ratio: float
    first: int = 0


def ema(x: str, period: int) -> Average:
    return Average(x, period, 1 - 2 / (period + 1))


def wilder(x: str, period: int) -> Average:
    return Average(x, period, (period - 1) / period, 1)


def block_length(averages: list[Average]) -> int:
    """The longest block in which the powers of every ratio stay within a double."""
    steepest = max((-math.log(a.ratio) for a in averages if a.ratio > 0 and a.period > 1), default=0.0)
    return max(n for n in LENGTHS if n == LENGTHS[0] or n * steepest <= LARGEST)


def by_block() -> WindowSpec:
    return Window.partitionBy("symbol", "_block").orderBy("idx")


def in_blocks(bars: DataFrame, size: int) -> DataFrame:
    """`bars` with _block, written once: every pass reads them twice."""
    return staged(bars.withColumn("_block", F.floor(F.col("idx") / size)), "bar-blocks")


def carried(blocks: DataFrame, columns: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(symbol, _block, columns): each column summed up, by its function, over all blocks of the symbol before this one.

    blocks: a small table of (symbol, _block, columns). Groups of GROUP blocks are scanned by themselves, and each
    group's sum meets all later ones, so no task holds more than a group. Null before a symbol's second block."""
    grouped = blocks.withColumn("_group", F.floor(F.col("_block") / GROUP))
    last = grouped.agg(F.max("_group")).first()[0] or 0
    before = Window.partitionBy("symbol", "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = [f(c).alias(c) for c, f in columns.items()]
    later = grouped.groupBy("symbol", "_group").agg(*sums).where(F.col("_group") < last)
    later = later.withColumn("_group", F.explode(F.sequence(F.col("_group") + 1, F.lit(last)))).groupBy("symbol", "_group").agg(*sums)
    own = grouped.select("symbol", "_block", "_group", *[f(c).over(before).alias(c) for c, f in columns.items()])
    above = later.join(grouped.select("symbol", "_group", "_block"), ["symbol", "_group"])
    both = own.select("symbol", "_block", *columns).unionAll(above.select("symbol", "_block", *columns))
    return both.groupBy("symbol", "_block").agg(*sums)


def numbered(bars: DataFrame, order: list[str]) -> DataFrame:
    """`bars` with idx from 0 in the order of some columns within each symbol, without a sort of a symbol in one task.

    Ranges of (symbol, order) are counted and the counts scanned. The order must tell bars of a symbol apart."""
    ranged = bars.repartitionByRange("symbol", *order).withColumn("_block", F.spark_partition_id())
    ranged = staged(ranged, "bar-ranges")
    starts = carried(ranged.groupBy("symbol", "_block").agg(F.count(F.lit(1)).alias("_start")), {"_start": F.sum})
    at = F.row_number().over(Window.partitionBy("symbol", "_block").orderBy(*order)) - 1
    found = ranged.withColumn("_at", at).join(starts, ["symbol", "_block"], "left")
    return found.withColumn("idx", F.col("_at") + F.coalesce("_start", F.lit(0))).drop("_at", "_start", "_block")


def with_before(bars: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Blocked, staged `bars` with the value that each column has one bar before, under a name of its own."""
    held = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
    edges = bars.groupBy("symbol", "_block").agg(F.max_by(held, "idx").alias("_edge")).withColumn("_block", F.col("_block") + 1)
    joined = bars.join(edges, ["symbol", "_block"], "left")
    x = joined.withColumn("_held", F.coalesce(F.lag(held).over(by_block()), F.col("_edge")))
    return x.withColumns({name: F.col(f"_held.{name}") for name in columns}).drop("_held", "_edge")


def _place(at: str, seat: int) -> str:
    return f"greatest({at}, {seat})"


def averaged(bars: DataFrame, averages: dict[str, Average], size: int) -> DataFrame:
    """Blocked, staged `bars` (blocks of `size`) with each average; null before its first value, and from the first null on.

    A block's sum, with each bar weighed by what is left of it at the block's end, goes to the blocks after it until it
    weighs less than a double resolves; within a block, sums over powers of the ratio run from its start."""
    summed, weights, reach = [], {}, {}
    for name, (x, period, q, first) in averages.items():
        seat, at = period - 1, f"(idx - {first})"
        end = f"((_block + 1) * {size} - 1 - {first})"
        weights[name] = f"CASE WHEN {at} < 0 THEN NULL WHEN {at} <= {seat} THEN {x} / {period} ELSE {1 - q!r}D * {x} END"
        if q > 0:
            left = f"power({q!r}D, {_place(end, seat)} - {_place(at, seat)})"
            summed.append(F.expr(f"coalesce(sum({weights[name]} * {left}), 0D)").alias(f"{name}_sum"))
            reach[name] = max(1, math.ceil(FORGOTTEN / (-math.log(q) * size)))
        summed.append(F.expr(f"count_if({at} >= 0 AND {x} IS NULL)").alias(f"{name}_missing"))
    blocks = staged(bars.groupBy("symbol", "_block").agg(*summed), "block-sums")
    carries = carried(blocks, {f"{name}_missing": F.sum for name in averages})
    last = blocks.agg(F.max("_block")).first()[0] or 0
    # sums of blocks before the seat's own one keep their weight up to it, so they reach as much further
    far = max((n + 2 + averages[name].period // size for name, n in reach.items()), default=0)
    sent = blocks.withColumn("_to", F.explode(F.sequence(F.col("_block") + 1, F.least(F.col("_block") + far, F.lit(last + 1)))))
    given = []
    for name in reach:
        _, period, q, first = averages[name]
        gap = f"{_place(f'(_to * {size} - 1 - {first})', period - 1)} - {_place(f'((_block + 1) * {size} - 1 - {first})', period - 1)}"
        given.append(F.expr(f"sum({name}_sum * power({q!r}D, {gap}))").alias(f"{name}_carry"))
    if given:
        given_to = sent.groupBy("symbol", F.col("_to").alias("_block")).agg(*given)
        carries = carries.join(given_to, ["symbol", "_block"], "left")
    joined = bars.join(carries, ["symbol", "_block"], "left")
    run = "OVER (PARTITION BY symbol, _block ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    out = {}
    for name, (x, period, q, first) in averages.items():
        seat, at, start = period - 1, f"(idx - {first})", f"(_block * {size} - {first})"
        value = x
        if q > 0:
            base, place = _place(start, seat), _place(at, seat)
            own = f"sum({weights[name]} * power({q!r}D, {base} - {place})) {run} * power({q!r}D, {place} - {base})"
            before = f"coalesce({name}_carry, 0D) * power({q!r}D, {place} - {_place(f'({start} - 1)', seat)})"
            value = f"coalesce({own}, 0D) + {before}"
        known = f"count_if({at} >= 0 AND {x} IS NULL) {run} + coalesce({name}_missing, 0) = 0"
        out[name] = F.expr(f"CASE WHEN {at} >= {seat} AND {known} THEN {value} END")
    drop = [c for name in averages for c in (f"{name}_missing", f"{name}_carry")]
    return joined.withColumns(out).drop(*drop)


def last_places(bars: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Blocked, staged `bars` with the idx of the last bar so far at which each condition held, null before one did."""
    found = {name: F.expr(f"max(CASE WHEN {when} THEN idx END)") for name, when in marks.items()}
    blocks = bars.groupBy("symbol", "_block").agg(*[c.alias(name) for name, c in found.items()])
    carries = carried(staged(blocks, "block-places"), {name: F.max for name in marks})
    carries = carries.withColumnsRenamed({name: f"{name}_carry" for name in marks})
    joined = bars.join(carries, ["symbol", "_block"], "left")
    run = "OVER (PARTITION BY symbol, _block ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    own = {name: F.expr(f"greatest(max(CASE WHEN {when} THEN idx END) {run}, {name}_carry)") for name, when in marks.items()}
    return joined.withColumns(own).drop(*[f"{name}_carry" for name in marks])


def moves(bars: DataFrame) -> DataFrame:
    """Blocked, staged `bars` with _up and _down: how far each close is above or below the one before."""
    x = with_before(bars, {"_close": "close"})
    step = "close - _close"
    return x.withColumns({"_up": F.expr(f"greatest({step}, 0D)"), "_down": F.expr(f"greatest(-({step}), 0D)")}).drop("_close")


def smoothed(bars: DataFrame, averages: dict[str, Average], rsi: int | None = None, size: int | None = None) -> DataFrame:
    """`bars` with each average, and rsi of that period if one is given; blocks of `size`, by default as long as the ratios allow."""
    both = dict(averages)
    if rsi:
        both |= {"_g": wilder("_up", rsi), "_l": wilder("_down", rsi)}
    size = min(size or LENGTHS[-1], block_length(list(both.values())))
    x = in_blocks(bars, size)
    x = averaged(staged(moves(x), "moves") if rsi else x, both, size)
    return (x.withColumn("rsi", relative_strength("_g", "_l")).drop("_up", "_down", "_g", "_l") if rsi else x).drop("_block")


def strategy(
    bars: DataFrame,
    rsi_len: int = 6,
    oversold: float = 20.0,
    overbought: float = 80.0,
    vol_len: int = 144,
    vol_mult: float = 2.0,
    periods=ribbon_strategy.RIBBON,
    warmup: int = ribbon_strategy.WARMUP,
    size: int | None = None,
) -> DataFrame:
    """`bars` with the columns of `strategy.strategy`, by scans over blocks of bars."""
    averages = {f"ema{p}": ema("close", p) for p in periods} | {"volume_ema": ema("volume", vol_len)}
    averages |= {"_g": wilder("_up", rsi_len), "_l": wilder("_down", rsi_len)}
    size = min(size or LENGTHS[-1], block_length(list(averages.values())))
    x = averaged(staged(moves(in_blocks(bars, size)), "moves"), averages, size)
    x = staged(ribbon_strategy.states(x, periods, vol_mult, oversold, overbought), "states")
    x = staged(with_before(x, {"_before": "_zone", "_rsi": "rsi"}), "states-before")
    x = staged(last_places(x, {"_began": "NOT _zone <=> _before", "_spike": "volume_spike"}), "excursions")
    x = with_before(x.withColumn("_held_zone", F.expr(ribbon_strategy.CONFIRMED)), {"_was": "_held_zone"})
    return ribbon_strategy.signalled(x, oversold, overbought, warmup).drop("_block", "_held_zone")
