"""Series scanned in blocks against the windows by symbol and against plain recurrences."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, scan, strategy
from tidemark.sources.shared import staged

N = 1_000_000
LOOSE = dict(oversold=40.0, overbought=60.0, vol_mult=1.5)


def plain_average(values, period, ratio, first=0):
    """y = ratio * y + (1 - ratio) * x, bar after bar."""
    out, y = [], None
    for at, x in enumerate(values, -first):
        seen = values[first : at + first + 1]
        if at < period - 1:
            y = None
        elif at == period - 1:
            y = None if None in seen else sum(seen) / period
        else:
            y = None if y is None or x is None else y * ratio + x * (1 - ratio)
        out.append(y)
    return out


def bars_of(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, i, v) for i, v in enumerate(values)], "symbol string, idx long, close double")


def close_to(got, want):
    return all((g is None) == (w is None) and (w is None or abs(g - w) <= 1e-9 * max(1, abs(w))) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("size", [8, 32, 2048])
def test_averages_across_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "GROUP", 3)
    rng = random.Random(7)
    values = [rng.uniform(1, 100) for _ in range(700)]
    holed = values[:400] + [None] + values[401:]
    bars = bars_of(spark, values).unionAll(bars_of(spark, holed, "B")).unionAll(bars_of(spark, values[:3], "C"))
    periods = {"a": 1, "b": 5, "c": 100, "d": 500}
    x = scan.smoothed(bars, {k: scan.ema("close", p) for k, p in periods.items()} | {"w": scan.wilder("close", 14)}, size=size)
    for symbol, series in (("A", values), ("B", holed), ("C", values[:3])):
        rows = x.where(F.col("symbol") == symbol).orderBy("idx").collect()
        for k, p in periods.items():
            assert close_to([r[k] for r in rows], plain_average(series, p, 1 - 2 / (p + 1)))
        assert close_to([r.w for r in rows], plain_average(series, 14, 13 / 14, 1))


def test_a_period_longer_than_any_block_forgets_nothing(spark):
    rng = random.Random(2)
    values = [rng.uniform(0, 1) for _ in range(5000)]
    x = scan.smoothed(bars_of(spark, values), {"a": scan.Average("close", 100, 1 - 1e-6)}, size=128)
    assert close_to([r.a for r in x.orderBy("idx").collect()], plain_average(values, 100, 1 - 1e-6))
    with pytest.raises(ValueError):
        indicators.ema("close", 10_000_000)


def test_no_bars_and_one_bar(spark):
    for n in (0, 1):
        x = scan.strategy(bars_of(spark, [1.0] * n).selectExpr("*", "close AS high", "close AS low", "close AS volume"))
        assert x.count() == n and x.where("signal IS NOT NULL").count() == 0


@pytest.fixture(scope="module")
def million(spark):
    noise = "(pmod(xxhash64(id, 'p'), 2000) - 1000) / 100D"
    close = F.expr(f"500D + 120D * sin(id / 9000D) + 40D * sin(id / 310D) + {noise}")
    x = spark.range(N).select(F.lit("A").alias("symbol"), F.col("id").alias("idx"), close.alias("close"))
    spike = "CASE WHEN pmod(xxhash64(idx, 'v'), 40) = 0 THEN 5000D ELSE 1000D + pmod(xxhash64(idx, 'u'), 100) END"
    x = x.withColumn("volume", F.expr(spike))
    return staged(x.withColumns({"high": F.col("close") + 3, "low": F.col("close") - 3}), "million")


def test_a_million_bars_of_one_symbol(spark, million):
    """All columns of the strategy, averages and index among them, as the windows by symbol have them."""
    columns = ["ema144", "ema987", "volume_ema", "rsi"]
    names = ["trend", "in_tunnel", "volume_spike", "signal"]
    a = scan.strategy(million, **LOOSE).select("idx", *columns, *names)
    b = strategy.strategy(million, **LOOSE).select("idx", *[F.col(c).alias(f"{c}_b") for c in columns + names])
    far = [F.expr(f"NOT {c} <=> {c}_b AND NOT coalesce(abs({c} - {c}_b) <= 1e-9 * abs({c}_b), false)") for c in columns]
    differs = [F.expr(f"NOT {c} <=> {c}_b") for c in names]
    both = a.join(b, "idx").agg(F.count(F.lit(1)).alias("n"), F.count("signal").alias("signals"), *[F.count_if(x).alias(f"d{k}") for k, x in enumerate(far + differs)]).first()
    assert both.n == N and both.signals > 100
    assert sum(both[f"d{k}"] for k in range(8)) == 0


def test_no_window_is_by_symbol_alone(spark, monkeypatch):
    plans = []

    def recorded(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(scan, "staged", recorded)
    bars = bars_of(spark, [float(i % 7) for i in range(300)]).selectExpr("*", "close AS high", "close AS low", "close AS volume")
    recorded(scan.strategy(scan.numbered(bars.drop("idx").withColumn("at", F.monotonically_increasing_id()), ["at"])), "last")
    windows = re.findall(r"Window \[.*\], \[(symbol#.*?)\], \[", "\n".join(plans))
    assert len(windows) >= 8 and all(re.fullmatch(r"symbol#\d+, _(block|group)#\d+L?", w) for w in windows)


def test_numbers_are_those_of_one_sort(spark, monkeypatch):
    monkeypatch.setattr(scan, "GROUP", 2)
    events = spark.range(20_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 'B' ELSE 'A' END AS symbol"), F.expr("xxhash64(id) AS at"))
    x = scan.numbered(events, ["at"])
    wrong = x.withColumn("want", F.expr("row_number() OVER (PARTITION BY symbol ORDER BY at) - 1")).where("idx != want")
    assert x.count() == 20_000 and wrong.count() == 0
