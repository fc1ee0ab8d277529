"""Provider payloads, landed as JSON text, to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import pct_change, rnd


def klines(df: DataFrame, body: str) -> DataFrame:
    """Positional candles: (other columns, open_time_ms, open, high, low, close, volume); of equal open times the first stays."""
    rest = [c for c in df.columns if c != body]
    rows = df.select(*rest, F.posexplode(F.from_json(body, "array<array<string>>")).alias("_at", "k"))
    number = lambda i: F.expr(f"try_cast(get(k, {i}) AS double)")
    named = F.struct(*[number(i).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)])
    opened = rows.withColumn("open_time_ms", F.expr("try_cast(get(k, 0) AS bigint)"))
    return opened.groupBy(*rest, "open_time_ms").agg(F.min_by(named, "_at").alias("k")).select(*rest, "open_time_ms", "k.*")


def market_series(df: DataFrame, body: str) -> DataFrame:
    """(other columns, start_price, end_price, return_pct, dates, volumes); volumes only if there are as many as prices."""
    rest = [c for c in df.columns if c != body]
    m = df.select(*rest, F.from_json(body, "prices array<array<double>>, total_volumes array<array<double>>").alias("m"))
    m = m.where(F.size("m.prices") > 0)
    price = F.transform("m.prices", lambda p: p[1])
    first, last = F.get(price, 0), F.element_at(price, -1)
    days = F.transform("m.prices", lambda p: F.date_format(F.timestamp_millis(p[0].cast("long")), "yyyy-MM-dd"))
    same = F.size("m.total_volumes") == F.size("m.prices")
    return m.select(
        *rest, first.alias("start_price"), last.alias("end_price"), pct_change(last, first).alias("return_pct"),
        days.alias("dates"), F.when(same, F.transform("m.total_volumes", lambda p: p[1])).alias("volumes"),
    )


def funding_bias(pct: Column) -> Column:
    return F.when(pct > 0.01, "long_crowded").when(pct < -0.01, "short_crowded").when(pct.isNotNull(), "balanced")


def funding(df: DataFrame, body: str) -> DataFrame:
    """(other columns, funding_rate_pct, bias) of a premium index payload."""
    rest = [c for c in df.columns if c != body]
    pct = rnd(F.expr(f"try_cast(get_json_object({body}, '$.lastFundingRate') AS double)") * 100, 4)
    return df.select(*rest, pct.alias("funding_rate_pct"), funding_bias(pct).alias("bias"))


def satoshi(amount: Column) -> Column:
    return rnd(amount.cast("double") / 1e8, 4)


def hex_wei(text: str) -> Column:
    """Ether of a hexadecimal wei amount of up to 30 digits, in two halves as one would not fit 64 bits."""
    digits = F.lpad(F.regexp_replace(F.lower(text), "^0x", ""), 30, "0")
    half = lambda at: F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(38,0)")
    wei = (half(1).cast("decimal(20,0)") * F.lit(16**15).cast("decimal(20,0)")).cast("decimal(38,0)") + half(16)
    return rnd((wei / F.lit(10**18).cast("decimal(20,0)")).cast("double"), 4)


def side_consistency(history: DataFrame, key: str, at: str, ratio: str) -> DataFrame:
    """(key, current, bias, consistency_pct): share of rows on the current row's side of 1; exactly 1 is the short side."""
    x = history.groupBy(key).agg(
        F.max_by(ratio, at).alias("current"),
        F.count(ratio).alias("n"),
        F.count(F.when(F.col(ratio) > 1, 1)).alias("longs"),
    )
    same = F.when(F.col("current") > 1, F.col("longs")).otherwise(F.col("n") - F.col("longs"))
    bias = F.when(F.col("current") > 1.02, "long_dominant").when(F.col("current") < 0.98, "short_dominant").otherwise("balanced")
    return x.select(key, rnd("current", 4).alias("current"), bias.alias("bias"), rnd(F.try_divide(same * 100.0, "n"), 1).alias("consistency_pct"))


def trend(series: DataFrame, key: str, order: str, value: str, days: int = 90, back: int = 30) -> DataFrame:
    """(key, latest, change_pct, change_back_pct, direction) of the last `days` known values and against the one `back` before."""
    late = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    x = series.where(F.col(value).isNotNull()).withColumn("_late", late).where(F.col("_late") <= days)
    y = x.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(value, order).alias("last"),
        F.min_by(value, order).alias("first"),
        F.max(F.when(F.col("_late") == back + 1, F.col(value))).alias("mid"),
    )
    change = pct_change(F.col("last"), F.col("first"))
    recent = pct_change(F.col("last"), F.coalesce("mid", "first"))
    direction = F.when(recent > 3, "expanding").when(recent < -3, "contracting").when(recent.isNotNull(), "stable").otherwise("unknown")
    return y.where("n >= 2").select(
        key, rnd("last", 4).alias("latest"), change.alias("change_pct"), recent.alias("change_30d_pct"), direction.alias("direction")
    )


def index_direction(series: DataFrame, key: str, order: str, value: str, limit: float = 5) -> DataFrame:
    """(key, first, last, delta, direction) of an index over its points, given in any order."""
    x = series.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    d = F.col("last") - F.col("first")
    return x.select(
        key, "first", "last", rnd(d, 2).alias("delta"), F.when(d > limit, "improving").when(d < -limit, "deteriorating").otherwise("stable").alias("direction")
    )


def heartbeat(df: DataFrame, body: str) -> DataFrame:
    """(other columns, height) of chain status payloads, decimal or hexadecimal; error envelopes have no row."""
    rest = [c for c in df.columns if c != body]
    raw = F.coalesce(F.get_json_object(body, "$.result"), F.get_json_object(body, "$.height"))
    height = F.when(F.lower(raw).startswith("0x"), F.conv(F.substring(raw, 3, 16), 16, 10)).otherwise(raw)
    good = F.get_json_object(body, "$.error").isNull() & raw.isNotNull()
    return df.where(good).select(*rest, height.try_cast("bigint").alias("height"))


def wallet_balances(df: DataFrame, known: DataFrame, body: str) -> DataFrame:
    """(other columns, label, address, balance) of address-keyed balance payloads for the known addresses (address, label)."""
    rest = [c for c in df.columns if c != body]
    rows = df.select(*rest, F.explode(F.from_json(body, "map<string, struct<final_balance: bigint>>")).alias("address", "b"))
    return rows.join(known, "address").select(*rest, "label", "address", satoshi(F.col("b.final_balance")).alias("balance"))
