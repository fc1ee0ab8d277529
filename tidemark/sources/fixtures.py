"""Deterministic bars for tests and dry runs, from a rule and a scale per symbol."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd

#: How many times the base price and volume a symbol has.
SCALES = {"BTC": 6.0, "ETH": 3.0, "SOL": 1.4, "BNB": 1.1, "XRP": 0.8}


def fixture_bars(spark: SparkSession, scales: dict[str, float] = SCALES, days: int = 14) -> DataFrame:
    """(symbol, bar, idx, open, high, low, close, volume): a price that rises 0.6 % of its base a day."""
    scale = spark.createDataFrame(list(scales.items()), "symbol string, s double")
    x = scale.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    close = rnd(100 * F.col("s") * (1 + 0.006 * F.col("idx")), 2)
    volume = rnd(1e9 * F.col("s") * (1 + 0.02 * (F.col("idx") % 5)), 2)
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("idx")), "yyyy-MM-dd")
    return x.select("symbol", day.alias("bar"), "idx", *[close.alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"))


def _content(symbol: str) -> list[tuple[str, str, str, float, dict]]:
    """(data type, source, time range, reliability, content) of a symbol's records, bars aside. Fixed values."""
    item = lambda title, n: {"title": title, "url": n, "published": ""}
    state = lambda trend, inside, rsi: {"trend": trend, "tunnel_top": None, "tunnel_bottom": None, "in_tunnel": inside, "rsi": rsi, "volume_spike": False, "last_signal": None, "bars_since_signal": None}
    release = item("Federal Reserve issues FOMC statement", "https://example.com/fomc")
    point = {"long_pct": 55.0, "short_pct": 45.0, "ratio": 1.2222}
    wallet = {"label": "Demo Exchange Wallet", "address": "0xDEMO0000000000000000000000000000000000", "balance": 500_000, "explorer_url": "https://example.com/whale"}
    posts = [
        {"title": f"{symbol} adoption thread", "url": "https://example.com/social/1", "score": 12, "comments": 4, "matched_positive": ["adoption"], "matched_negative": []},
        {"title": f"{symbol} drop discussion", "url": "https://example.com/social/2", "score": 7, "comments": 2, "matched_positive": [], "matched_negative": ["drop"]},
    ]
    fear = [{"time": "2026-01-01", "value": 47, "classification": "Neutral"}, {"time": "2026-01-14", "value": 52, "classification": "Neutral"}]
    return [
        ("market", "MockMarket", "14d", 0.80, {"return_pct": 8.2, "rsi": 61.4}),
        ("news", "MockNews", "14d", 0.60, {"headline": "Network activity remains elevated", "sentiment": "positive", "items": [item(f"{symbol} network activity remains elevated", "https://example.com/news/1"), item(f"{symbol} developer activity steady week over week", "https://example.com/news/2")]}),
        ("social", "MockSocial", "14d", 0.35, {"sentiment": "mixed", "confidence": 0.45, "positive_terms": 3, "negative_terms": 3, "posts": posts}),
        ("derivatives", "MockDerivatives", "current", 0.75, {"symbol": f"{symbol}USDT", "funding_rate_pct": 0.008, "bias": "balanced"}),
        ("whale", "MockWhaleWatch", "current", 0.65, {"wallets": [wallet], "note": "Demo fixture only"}),
        ("vegas_channel", "MockVegasChannel", "4h trend / 1h execution", 0.70, {"symbol": f"{symbol}USDT", "trend_timeframe": "4h", "execution_timeframe": "1h", "4h": state("bullish_aligned", True, 55.0), "1h": state("mixed", False, 48.0), "alignment": {"passed": False, "4h_direction": "long", "1h_direction": "neutral"}}),
        ("long_short_ratio", "MockLongShortRatio", "last 24x1h", 0.70, {"symbol": f"{symbol}USDT", "period": "1h", "history": [point], "current": point, "bias": "long_dominant", "consistency_pct": 80.0}),
        ("macro", "MockMacro", "14d", 0.80, {"fear_greed_value": 52, "fear_greed_classification": "Neutral", "fear_greed_history": fear, "fear_greed_change_14d": 5, "risk_appetite_direction": "risk_appetite_stable", "fed_releases": [release], "latest_fomc_release": release, "fed_status": "available"}),
        ("announcement", "MockOfficialAnnouncements", "recent", 0.85, {"items": [item(f"{symbol} protocol update published", "https://example.com/announcement/1")], "first_party": True, "note": "Demo fixture only"}),
    ]


def fixture_records(spark: SparkSession, scales: dict[str, float] = SCALES, fetched_at: str = "2026-01-15T00:00:00+00:00") -> DataFrame:
    """Nine records of each symbol, one a data type, for tests and dry runs; the market's has the 14 bars of `fixture_bars`."""
    rows = [
        (symbol, n, kind, f"EV-{n:03}", source, f"https://example.com/{path}", fetched_at, time_range, json.dumps(content), reliability)
        for symbol in scales
        for n, (kind, source, time_range, reliability, content) in enumerate(_content(symbol), 1)
        for path in [{"vegas_channel": "vegas"}.get(kind, kind)]
    ]
    schema = "symbol string, ordinal int, data_type string, evidence_id string, source string, source_url string, fetched_at string, time_range string, content string, reliability_score double"
    series = lambda c: F.array_sort(F.collect_list(F.struct("idx", c)))[c].alias(c)
    bars = fixture_bars(spark, scales).groupBy("symbol").agg(*[series(c) for c in ("close", "volume", "bar")])
    lists = F.struct(F.element_at("close", 1).alias("start_price"), F.element_at("close", -1).alias("end_price"), F.col("close").alias("prices"), F.col("volume").alias("volumes"), F.col("bar").alias("dates"))
    whole = F.concat(F.regexp_replace("content", r"\}$", ", "), F.substring(F.to_json(lists), 2, 1 << 20))
    x = spark.createDataFrame(rows, schema).join(bars, "symbol").withColumn("content", F.when(F.col("data_type") == "market", whole).otherwise(F.col("content")))
    return x.drop("close", "volume", "bar")
