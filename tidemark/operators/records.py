"""Evidence records with their content as JSON: what stands in for a source that failed, facts in words, metrics for the rules.

records: (symbol, data_type, evidence_id, content), content JSON text in the shape that its source has. Content that is
broken or lacks a field is one without it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import grouped
from tidemark.operators.evidence import FALLBACK
from tidemark.sources.shapes import field

#: What a failed source's record has besides its status (data type, id prefix, source, url, time range, content).
FALLBACKS = [
    ("market", "EV-001", "MockMarket", "https://example.com/market", "14d", {}),
    ("news", "EV-002", "MockNews", "https://example.com/news", "14d", {"items": []}),
    ("social", "EV-003", "MockSocial", "https://example.com/social", "14d", {"posts": []}),
    ("onchain", "EV-ONCHAIN", "Offline chain fixture", "https://example.com/onchain", "current", {}),
    ("derivatives", "EV-DERIV", "Offline funding-rate fixture", "https://example.com/derivatives", "current", {"bias": "unknown"}),
    ("whale", "EV-WHALE", "Offline whale-wallet fixture", "https://example.com/whale", "current", {"wallets": []}),
    ("vegas_channel", "EV-VEGAS", "Offline Vegas Channel fixture", "https://example.com/vegas", "4h trend / 1h execution", {}),
    ("long_short_ratio", "EV-LSRATIO", "Offline long/short ratio fixture", "https://example.com/long_short_ratio", "current", {"bias": "unknown", "history": []}),
    ("macro", "EV-MACRO", "Offline macro fixture", "https://example.com/macro", "14d", {"fear_greed_history": [], "fed_releases": [], "risk_appetite_direction": "unknown"}),
    ("announcement", "EV-ANNOUNCE", "Offline announcement fixture", "https://example.com/announcement", "recent", {"first_party": False, "items": []}),
    ("tvl", "EV-TVL", "Offline chain TVL fixture", "https://example.com/tvl", "90d", {"direction": "unknown", "history": []}),
]
#: Titles of a news and of an announcement fact, and code points of an announcement's title.
HEADLINES, NOTICES, TITLE = 3, 2, 50


def fallback_records(missing: DataFrame, spark: SparkSession) -> DataFrame:
    """Whole records for sources that have none: missing (symbol, data_type, status, reason) to all columns of a record.

    status is `unsupported` or `unavailable`; the content says so beside what a source of the type has when it is empty, the
    reference is marked as a fallback and the claim says that it is not live. Unknown data types have no record."""
    known = [(t, i, s, u, r, json.dumps(c, sort_keys=True)[1:-1]) for t, i, s, u, r, c in FALLBACKS]
    spec = spark.createDataFrame(known, "data_type string, prefix string, source string, source_url string, time_range string, extra string")
    x = missing.join(F.broadcast(spec), "data_type")
    state = F.regexp_replace(F.to_json(F.struct("status", "reason")), r"\}$", "")
    content = F.concat(state, F.when(F.col("extra") != "", F.concat(F.lit(", "), "extra")).otherwise(""), F.lit("}"))
    return x.select(
        F.concat_ws("-", "prefix", "symbol", F.lit("FALLBACK")).alias("evidence_id"), "source", "source_url", "data_type", "symbol", "time_range",
        content.alias("content"), F.lit(FALLBACK).alias("reliability_score"),
        F.to_json(F.struct(F.lit(True).alias("fallback"), F.col("reason").alias("error_type"))).alias("content_reference"),
        F.concat("data_type", F.lit(" is not known for "), "symbol", F.lit("; this record is no live evidence")).alias("related_claim"),
    )


def _titles(items: Column, most: int, cut: int | None = None) -> Column:
    """The first titles of items that have one, quoted, in one text; empty without any."""
    titles = F.filter(F.transform(items, lambda i: F.coalesce(field(i, "$.title"), F.lit(""))), lambda t: t != "")
    shown = F.transform(F.slice(titles, 1, most), lambda t: F.concat(F.lit('"'), F.substring(t, 1, cut) if cut else t, F.lit('"')))
    return F.coalesce(F.array_join(shown, "; "), F.lit(""))


def _words(posts: Column, kind: str) -> Column:
    found = F.flatten(F.transform(posts, lambda p: F.coalesce(field(p, f"$.{kind}", "array<string>"), F.array().cast("array<string>"))))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(found)), ", "), F.lit(""))


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def facts(records: DataFrame) -> DataFrame:
    """(symbol, data_type, evidence_id, fact): what each record says, in words, with its values; each type has a form of its own."""
    x = records.withColumn("_v", F.try_parse_json("content"))
    at = lambda path, kind="string": field("_v", path, kind)
    array = lambda path: at(path, "array<variant>")
    shown = lambda path: F.coalesce(at(path), F.lit("N/A"))
    news = _titles(array("$.items"), HEADLINES)
    plus, minus = (_words(array("$.posts"), f"matched_{k}") for k in ("positive", "negative"))
    heard = F.concat_ws("; ", F.when(plus != "", _said("for: ", plus)), F.when(minus != "", _said("against: ", minus)))
    biases = {"long_crowded": "longs pay much", "short_crowded": "shorts pay much", "balanced": "both sides pay alike"}
    sides = {"long_dominant": "longs hold more", "short_dominant": "shorts hold more", "balanced": "both sides hold alike"}
    in_words = lambda path, words: F.coalesce(F.create_map(*[F.lit(w) for pair in words.items() for w in pair])[at(path)], F.lit("which way is not known"))
    wallets = F.array_join(F.transform(array("$.wallets"), lambda w: _said(field(w, "$.label"), " ", grouped(field(w, "$.balance", "double"), 0))), "; ")
    signal = F.when(at('$["1h"].last_signal').isNotNull(), _said("last signal ", at('$["1h"].last_signal'), " ", shown('$["1h"].bars_since_signal'), " bars ago")).otherwise("no signal yet")
    spike = F.when(at('$["1h"].volume_spike', "boolean"), "volume spikes").otherwise("volume is usual")
    agree = F.when(at("$.alignment.passed", "boolean"), "timeframes agree").when(~at("$.alignment.passed", "boolean"), "timeframes disagree").otherwise("agreement is not known")
    change = at("$.fear_greed_change_14d", "int")
    policy = F.when(F.coalesce(at("$.latest_fomc_release.title"), F.lit("")) != "", _said('; latest policy release "', at("$.latest_fomc_release.title"), '"')).otherwise("; no policy release")
    feed = F.when(at("$.first_party", "boolean"), "the project's own feed").otherwise("syndicated news")
    notices = F.size(array("$.items"))
    forms = {
        "market": _said("the price moved ", shown("$.return_pct"), " % over the period"),
        "news": F.when(news != "", _said("recent headlines are ", news)).otherwise("there are no headlines"),
        "social": _said("the mood is ", F.coalesce(at("$.sentiment"), F.lit("unknown")), " (", F.when(heard != "", heard).otherwise("no telling words"), ")"),
        "derivatives": F.when(at("$.funding_rate_pct").isNotNull(), _said("funding is ", at("$.funding_rate_pct"), " %, ", in_words("$.bias", biases))).otherwise("funding is not known"),
        "whale": F.when(F.size(array("$.wallets")) > 0, _said("known wallets hold ", wallets)).otherwise("no wallets are known"),
        "vegas_channel": F.when(
            at('$["4h"].trend').isNotNull() & at('$["1h"].trend').isNotNull(),
            _said("the trend is ", at('$["4h"].trend'), ", RSI ", shown('$["1h"].rsi'), ", ", spike, ", ", signal, ", ", agree),
        ).otherwise("the channel is not known"),
        "long_short_ratio": F.when(
            at("$.current.long_pct").isNotNull(),
            _said(at("$.current.long_pct"), " % long and ", shown("$.current.short_pct"), " % short, ", in_words("$.bias", sides), ", ", shown("$.consistency_pct"), " % of the time"),
        ).otherwise("the ratio is not known"),
        "macro": F.when(
            at("$.fear_greed_value").isNotNull(),
            _said("fear and greed is ", at("$.fear_greed_value"), " (", shown("$.fear_greed_classification"), "), ", F.coalesce(F.format_string("%+d", change), F.lit("N/A")), " in 14 days", policy),
        ).otherwise("fear and greed is not known"),
        "announcement": F.when(notices > 0, _said(notices.cast("string"), " announcements from ", feed, ": ", _titles(array("$.items"), NOTICES, TITLE))).otherwise("there are no announcements"),
    }
    fact = _said(F.col("data_type"), " was observed")
    for kind, form in forms.items():
        fact = F.when(F.col("data_type") == kind, form).otherwise(fact)
    return x.select("symbol", "data_type", "evidence_id", _said(F.col("evidence_id"), ": ", fact).alias("fact"))


def metrics_of_records(records: DataFrame) -> DataFrame:
    """One row per symbol: all that the signal rules look at, each from the content of its own record.

    records: (symbol, ordinal, data_type, content); of several of a type the first by ordinal and content counts. What no record has is null."""
    v = records.withColumn("_v", F.try_parse_json("content"))
    wanted = {
        "return_pct": ("market", "$.return_pct", "double"), "trend": ("vegas_channel", '$["4h"].trend', "string"), "aligned": ("vegas_channel", "$.alignment.passed", "boolean"),
        "rsi": ("vegas_channel", '$["1h"].rsi', "double"), "volume_spike": ("vegas_channel", '$["1h"].volume_spike', "boolean"), "funding_pct": ("derivatives", "$.funding_rate_pct", "double"),
        "funding_bias": ("derivatives", "$.bias", "string"), "long_pct": ("long_short_ratio", "$.current.long_pct", "double"), "ratio_bias": ("long_short_ratio", "$.bias", "string"),
        "consistency_pct": ("long_short_ratio", "$.consistency_pct", "double"), "sentiment": ("social", "$.sentiment", "string"), "fear_greed": ("macro", "$.fear_greed_value", "double"),
        "risk_appetite": ("macro", "$.risk_appetite_direction", "string"), "change_30d": ("tvl", "$.change_30d_pct", "double"), "tvl_direction": ("tvl", "$.direction", "string"),
    }
    first = lambda kind, value: F.min_by(F.struct(value.alias("v")), F.when(F.col("data_type") == kind, F.struct("ordinal", "content"))).getField("v")
    values = [first(kind, field("_v", path, what)).alias(name) for name, (kind, path, what) in wanted.items()]
    items = F.size(field("_v", "$.items", "array<variant>"))
    out = v.groupBy("symbol").agg(*values, first("announcement", items).alias("announcements"))
    # a bias counts only beside the current ratio that it is of
    return out.withColumn("ratio_bias", F.when(F.col("long_pct").isNotNull(), F.col("ratio_bias")))
