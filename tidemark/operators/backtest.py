"""Walk-forward backtest of signals as relational segments: trades, equity and summary, many symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import pct_change, rnd
from tidemark.operators.strategy import WARMUP

#: The side that each signal enters or leaves.
ENTRIES = {"bull_entry": "long", "bear_entry": "short"}
EXITS = {"take_profit_bull": "long", "take_profit_bear": "short"}
VARIANTS = ("long_only", "long_short")


def _side(signal: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, side in table.items():
        out = F.when(signal == name, side).otherwise(out)
    return out


def positions(states: DataFrame, variants=VARIANTS) -> DataFrame:
    """Each bar once per variant with `state`, the side held after it, and `held`, the side held before it.

    The last entry's side holds until the first matching exit after it. Long-only does not see short entries."""
    x = states.select("symbol", "bar", "idx", "close", "signal").withColumn(
        "variant", F.explode(F.array(*[F.lit(v) for v in variants]))
    )
    signal = F.when((F.col("variant") == "long_only") & (F.col("signal") == "bear_entry"), None).otherwise(F.col("signal"))
    x = x.withColumn("_s", signal)
    by = Window.partitionBy("symbol", "variant").orderBy("idx")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_entry", _side(F.col("_s"), ENTRIES))
    x = x.withColumns({"_side": F.last("_entry", ignorenulls=True).over(run), "_seg": F.count("_entry").over(run)})
    inside = Window.partitionBy("symbol", "variant", "_seg").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    left = F.coalesce((_side(F.col("_s"), EXITS) == F.col("_side")).cast("int"), F.lit(0))
    x = x.withColumn("_left", F.max(left).over(inside))
    x = x.withColumn("state", F.when(F.col("_left") == 0, F.col("_side")))
    x = x.withColumn("held", F.lag("state").over(by))
    return x.drop("_s", "_entry", "_side", "_seg", "_left")


def trades(held: DataFrame, fee_pct: float = 0.1) -> DataFrame:
    """One row per trade: (symbol, variant, side, entry and exit idx, date and price, bars_held, net, return_pct, exit_reason).

    A trade ends where the state changes next, or at the last bar. Short returns are linear; fees are taken at both ends."""
    fee = (1 - fee_pct / 100) ** 2
    ends = held.groupBy("symbol", "variant").agg(
        F.max("idx").alias("_last"), F.max_by("bar", "idx").alias("_last_bar"), F.max_by("close", "idx").alias("_last_close")
    )
    changes = held.where(~F.col("state").eqNullSafe(F.col("held")))
    by = Window.partitionBy("symbol", "variant").orderBy("idx")
    follow = changes.withColumns({f"_{c}": F.lead(c).over(by) for c in ("idx", "bar", "close", "state")})
    opened = follow.where(F.col("state").isNotNull()).join(ends, ["symbol", "variant"])
    open_end = F.col("_idx").isNull()
    pick = lambda a, b: F.when(open_end, F.col(b)).otherwise(F.col(a))
    out = opened.select(
        "symbol",
        "variant",
        F.col("state").alias("side"),
        F.col("idx").alias("entry_idx"),
        pick("_idx", "_last").alias("exit_idx"),
        F.col("bar").alias("entry_date"),
        pick("_bar", "_last_bar").alias("exit_date"),
        F.col("close").alias("_in"),
        pick("_close", "_last_close").alias("_out"),
        F.when(open_end, "end_of_data").when(F.col("_state").isNull(), "take_profit").otherwise("reverse").alias("exit_reason"),
    )
    raw = F.try_divide(F.col("_out") - F.col("_in"), F.col("_in"))
    net = (1 + F.when(F.col("side") == "long", raw).otherwise(-raw)) * fee - 1
    return out.withColumns(
        {
            "net": net,
            "entry_price": rnd("_in", 4),
            "exit_price": rnd("_out", 4),
            "bars_held": (F.col("exit_idx") - F.col("entry_idx")).cast("int"),
            "return_pct": rnd(net * 100, 2),
        }
    ).drop("_in", "_out")


def equity_curve(held: DataFrame, done: DataFrame, fee_pct: float = 0.1, warmup: int = WARMUP) -> DataFrame:
    """(symbol, variant, bar, idx, equity) of the test bars: closed trades times the open one at market, both fees included.

    The bar of an entry is still flat. With a position at the end, the last bar has the value after its forced close."""
    fee = (1 - fee_pct / 100) ** 2
    key = ["symbol", "variant"]
    closed = done.where(F.col("exit_reason") != "end_of_data").select(
        *key, F.col("exit_idx").alias("idx"), (1 + F.col("net")).alias("_factor")
    )
    opened = done.select(*key, F.col("entry_idx").alias("idx"), F.lit(True).alias("_opened"))
    by = Window.partitionBy(*key).orderBy("idx")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    x = held.join(closed, [*key, "idx"], "left").join(opened, [*key, "idx"], "left")
    x = x.withColumns(
        {
            "_done": F.coalesce(F.product(F.coalesce("_factor", F.lit(1.0))).over(before), F.lit(1.0)),
            "_in": F.last(F.when(F.col("_opened"), F.col("close")), ignorenulls=True).over(before),
        }
    )
    raw = F.try_divide(F.col("close") - F.col("_in"), F.col("_in"))
    open_value = F.col("_done") * (1 + F.when(F.col("held") == "long", raw).otherwise(-raw)) * fee
    value = F.when(F.col("held").isNotNull(), open_value).otherwise(F.col("_done"))
    final = done.groupBy(*key).agg(F.product(1 + F.col("net")).alias("_final"), F.max("exit_idx").alias("_end"))
    ended = done.where(F.col("exit_reason") == "end_of_data").select(*key, F.col("exit_idx").alias("_forced"))
    x = x.withColumn("_value", value).join(final, key, "left").join(ended, key, "left")
    settled = F.when(F.col("idx") == F.col("_forced"), F.col("_final")).otherwise(F.col("_value"))
    return x.where(F.col("idx") >= warmup).select(*key, "bar", "idx", rnd(settled, 6).alias("equity"))


def buy_and_hold(held: DataFrame, warmup: int = WARMUP) -> DataFrame:
    test = held.where(F.col("idx") >= warmup)
    first, last = F.min_by("close", "idx"), F.max_by("close", "idx")
    return test.groupBy("symbol", "variant").agg(
        F.min("bar").alias("date_start"),
        F.max("bar").alias("date_end"),
        F.count(F.lit(1)).alias("test_bars"),
        F.count("held").alias("_in_market"),
        pct_change(last, first).alias("buy_hold_return_pct"),
    )


def summary(held: DataFrame, done: DataFrame, curve: DataFrame) -> DataFrame:
    """One row per symbol and variant of at least one test bar. Wins are trades whose rounded return is positive."""
    key = ["symbol", "variant"]
    peak = F.max("equity").over(Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    fall = curve.withColumn("_fall", F.try_divide(F.col("equity") - peak, peak)).groupBy(*key).agg(
        rnd(F.least(F.lit(0.0), F.min("_fall")) * 100, 2).alias("max_drawdown_pct")
    )
    win, r = F.col("return_pct") > 0, F.col("return_pct")
    gross_win, gross_loss = F.sum(F.when(win, r)), -F.sum(F.when(~win, r))
    wins, losses = F.count(F.when(win, 1)), F.count(F.when(~win, 1))
    stats = done.groupBy(*key).agg(
        F.product(1 + F.col("net")).alias("_equity"),
        F.count(F.lit(1)).alias("trade_count"),
        wins.alias("win_count"),
        losses.alias("loss_count"),
        rnd(F.try_divide(wins, F.count(F.lit(1))) * 100, 1).alias("win_rate_pct"),
        rnd(F.try_divide(gross_win, wins), 2).alias("avg_win_pct"),
        rnd(-F.try_divide(gross_loss, losses), 2).alias("avg_loss_pct"),
        rnd(F.try_divide(F.coalesce(gross_win, F.lit(0.0)), gross_loss), 2).alias("profit_factor"),
        rnd(F.avg("bars_held"), 1).alias("avg_bars_held"),
    )
    x = buy_and_hold(held).join(fall, key, "left").join(stats, key, "left")
    total = (F.coalesce("_equity", F.lit(1.0)) - 1) * 100
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("trade_count", "win_count", "loss_count")}
    return x.withColumns(counts).select(
        *key,
        "date_start",
        "date_end",
        "test_bars",
        rnd(total, 2).alias("strategy_return_pct"),
        "buy_hold_return_pct",
        rnd(total - F.col("buy_hold_return_pct"), 2).alias("excess_return_pct"),
        *counts,
        "win_rate_pct",
        "avg_win_pct",
        "avg_loss_pct",
        "profit_factor",
        "max_drawdown_pct",
        rnd(F.try_divide("_in_market", "test_bars") * 100, 1).alias("exposure_pct"),
        "avg_bars_held",
    )
