"""Window forms against the sequential recurrences and state machines they stand for."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import backtest, indicators, strategy

SMALL = dict(periods=(3, 5, 8, 12, 20), vol_len=6, vol_mult=1.05, oversold=40.0, overbought=60.0, warmup=25)


def walk(seed, n=400, symbols=4):
    rng, rows = np.random.RandomState(seed), []
    for s in range(symbols):
        close = 100 * np.exp(np.cumsum(rng.randn(n) * 0.02 + rng.choice([-0.004, 0, 0.004])))
        for i, c in enumerate(close):
            rows.append((f"S{s}", f"{i:05d}", i, float(c), float(c * 1.01), float(c * 0.99), float(rng.rand() * 1000)))
    return pd.DataFrame(rows, columns=["symbol", "bar", "idx", "close", "high", "low", "volume"])


def seq_ema(x, p):
    out, k = [None] * len(x), 2 / (p + 1)
    if len(x) >= p:
        v = sum(x[:p]) / p
        out[p - 1] = v
        for i in range(p, len(x)):
            v = x[i] * k + v * (1 - k)
            out[i] = v
    return out


def seq_rsi(x, p):
    out = [None] * len(x)
    up = [max(b - a, 0) for a, b in zip(x, x[1:])]
    down = [max(a - b, 0) for a, b in zip(x, x[1:])]
    if len(up) < p:
        return out
    g, d = sum(up[:p]) / p, sum(down[:p]) / p
    for i in range(p, len(x)):
        if i > p:
            g, d = (g * (p - 1) + up[i - 1]) / p, (d * (p - 1) + down[i - 1]) / p
        out[i] = 100.0 if d == 0 else 0.0 if g == 0 else 100 - 100 / (1 + g / d)
    return out


def seq_signals(t, periods, vol_len, vol_mult, oversold, overbought, warmup):
    c, h, lo, v = (t[k].tolist() for k in ("close", "high", "low", "volume"))
    e = [seq_ema(c, p) for p in periods]
    r, va = seq_rsi(c, 6), seq_ema(v, vol_len)
    out, low_spike, high_spike = [], False, False
    for i in range(len(c)):
        was_low, was_high = low_spike, high_spike
        spike = va[i] is not None and v[i] > va[i] * vol_mult
        if r[i] is not None:
            low_spike = (low_spike or spike) if r[i] < oversold else False
            high_spike = (high_spike or spike) if r[i] > overbought else False
        known = all(x[i] is not None for x in e)
        bull = known and all(a[i] > b[i] for a, b in zip(e, e[1:]))
        bear = known and all(a[i] < b[i] for a, b in zip(e, e[1:]))
        tunnel = False
        if e[0][i] is not None and e[-1][i] is not None:
            a, b = sorted((e[0][i], e[-1][i]))
            tunnel = any(a <= x <= b for x in (c[i], h[i], lo[i]))
        ready = i > 0 and r[i] is not None and r[i - 1] is not None
        over = ready and r[i - 1] < oversold <= r[i]
        under = ready and r[i - 1] > overbought >= r[i]
        s = None
        if over and bull and tunnel and was_low:
            s = "bull_entry"
        elif under and bear and tunnel and was_high:
            s = "bear_entry"
        elif under and was_high:
            s = "take_profit_bull"
        elif over and was_low:
            s = "take_profit_bear"
        out.append(s if i >= warmup else None)
    return out


def seq_backtest(close, signals, short, fee, warmup):
    side, price, at, eq, curve, done, inside = None, 0.0, 0, 1.0, [], [], 0
    f = (1 - fee / 100) ** 2

    def close_at(i):
        nonlocal eq, side
        raw = (close[i] - price) / price
        net = (1 + (raw if side == "long" else -raw)) * f - 1
        eq *= 1 + net
        done.append((side, at, i, round(net, 9)))
        side = None

    for i in range(warmup, len(close)):
        if side:
            inside += 1
            raw = (close[i] - price) / price
            curve.append(eq * (1 + (raw if side == "long" else -raw)) * f)
        else:
            curve.append(eq)
        s = signals[i]
        if s in backtest.EXITS and backtest.EXITS[s] == side:
            close_at(i)
        elif s in backtest.ENTRIES:
            want = backtest.ENTRIES[s]
            if want == "short" and not short or want == side:
                continue
            if side:
                close_at(i)
            side, price, at = want, close[i], i
    if side:
        close_at(len(close) - 1)
        curve[-1] = eq
    return done, curve, eq, inside


@pytest.mark.parametrize("period", [5, 144])
def test_ema_is_the_recurrence(spark, period):
    t = walk(1)
    got = spark.createDataFrame(t).withColumn("e", indicators.ema("close", period)).toPandas()
    for _, g in got.sort_values("idx").groupby("symbol"):
        want = seq_ema(g.close.tolist(), period)
        assert [x is None for x in want] == g.e.isna().tolist()
        np.testing.assert_allclose(g.e.dropna(), [x for x in want if x is not None], rtol=1e-12)


def test_rsi_is_the_recurrence_and_its_edges(spark):
    flat = pd.DataFrame({"symbol": "F", "bar": [str(i) for i in range(9)], "idx": range(9), "close": 5.0})
    t = pd.concat([walk(2)[["symbol", "bar", "idx", "close"]], flat])
    got = indicators.wilder_rsi(spark.createDataFrame(t), 6).toPandas()
    for _, g in got.sort_values("idx").groupby("symbol"):
        want = seq_rsi(g.close.tolist(), 6)
        assert [x is None for x in want] == g.rsi.isna().tolist()
        np.testing.assert_allclose(g.rsi.dropna(), [x for x in want if x is not None], rtol=1e-9)


def long_walk(n=100_000):
    rng = np.random.RandomState(1)
    level, out = 0.0, []
    for i in range(n):
        level = 0.9995 * level + rng.randn() * 0.02
        out.append(100 * np.exp(level + 0.3 * np.sin(i / 3000)))
    c = np.array(out)
    return pd.DataFrame(
        {"symbol": "L", "bar": [f"{i:06d}" for i in range(n)], "idx": range(n), "close": c, "high": c * 1.01, "low": c * 0.99, "volume": rng.rand(n) * 1000}
    )


def test_long_series_are_the_recurrence_and_give_the_same_signals(spark):
    t = long_walk()
    got = strategy.strategy(spark.createDataFrame(t), oversold=40.0, overbought=60.0, vol_mult=1.0).toPandas().sort_values("idx")
    for p in strategy.RIBBON:
        want = np.array([np.nan if x is None else x for x in seq_ema(t.close.tolist(), p)])
        np.testing.assert_allclose(got[f"ema{p}"].to_numpy(), want, rtol=1e-9)
    np.testing.assert_allclose(got.rsi.to_numpy(), np.array([np.nan if x is None else x for x in seq_rsi(t.close.tolist(), 6)]), atol=1e-9)
    want = seq_signals(t, strategy.RIBBON, 144, 1.0, 40.0, 60.0, 988)
    assert [None if pd.isna(x) else x for x in got.signal] == want and sum(x is not None for x in want) > 1000


@pytest.mark.parametrize("period", [1, 2, 3])
def test_short_memories_over_many_blocks(spark, period):
    t = long_walk(3000)
    got = spark.createDataFrame(t).withColumn("e", indicators.ema("close", period)).toPandas().sort_values("idx")
    np.testing.assert_allclose(got.e.to_numpy()[period - 1 :], seq_ema(t.close.tolist(), period)[period - 1 :], rtol=1e-12)


def test_an_average_is_unknown_from_the_first_null_on(spark):
    t = spark.createDataFrame([("N", i, None if i == 7 else float(i)) for i in range(12)], "symbol string, idx int, close double")
    got = t.withColumn("e", indicators.ema("close", 3)).orderBy("idx").collect()
    assert [r.e is None for r in got] == [i < 2 or i >= 7 for i in range(12)]


def test_signals_equal_the_sequential_state_machine(spark):
    t = walk(10, symbols=12)
    got = strategy.strategy(spark.createDataFrame(t), **SMALL).toPandas()
    fired = 0
    for _, g in got.sort_values("idx").groupby("symbol"):
        want = seq_signals(g, **SMALL)
        fired += sum(x is not None for x in want)
        assert want == [None if pd.isna(x) else x for x in g.signal]
    assert fired > 20


def test_trades_and_equity_equal_the_sequential_engine(spark):
    t, rng = walk(11, n=120, symbols=20), np.random.RandomState(5)
    names = [*backtest.ENTRIES, *backtest.EXITS]
    t["signal"] = [names[rng.randint(4)] if i >= 25 and rng.rand() < 0.15 else None for i in t.idx]
    states = spark.createDataFrame(t)
    held = backtest.positions(states).cache()
    done = backtest.trades(held).cache()
    line = backtest.equity_curve(held, done, warmup=25).cache()
    curve, found = line.toPandas(), done.toPandas()
    total = 0
    for s, g in t.groupby("symbol"):
        for variant in backtest.VARIANTS:
            trades, want, _, _ = seq_backtest(g.close.tolist(), g.signal.tolist(), variant == "long_short", 0.1, 25)
            total += len(trades)
            own = found[(found.symbol == s) & (found.variant == variant)].sort_values("entry_idx")
            assert [(r.side, r.entry_idx, r.exit_idx, round(r.net, 9)) for r in own.itertuples()] == trades
            mine = curve[(curve.symbol == s) & (curve.variant == variant)].sort_values("idx")
            np.testing.assert_allclose(mine.equity, want, atol=1e-6)
    assert total > 100


def test_prefix_gives_the_same_signals(spark):
    t = walk(30)
    whole = strategy.strategy(spark.createDataFrame(t), **SMALL).select("symbol", "idx", "signal").toPandas()
    part = strategy.strategy(spark.createDataFrame(t[t.idx < 222]), **SMALL).select("symbol", "idx", "signal").toPandas()
    m = part.merge(whole, on=["symbol", "idx"])
    assert (m.signal_x.fillna("") == m.signal_y.fillna("")).all()


def test_downsample_keeps_ends_and_positions(spark):
    t = spark.createDataFrame(walk(4, n=401, symbols=1))
    got = sorted(r.idx for r in indicators.downsample(t, 60).collect())
    assert got == sorted({round(k * 400 / 59) for k in range(60)})
    assert indicators.downsample(t, 500).count() == 401
