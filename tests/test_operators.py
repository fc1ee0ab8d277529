"""Golden vectors and invariants of evidence, signals, comparison, text, payloads and streaming."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import compare, evidence, indicators, reasoning, signals
from tidemark.plans import sinks
from tidemark.sources import fixtures, payloads, tables
from tidemark.streaming.bars import run_bars


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "weights, stance, top",
    [
        ([("bull", 1.2), ("bull", 1.0), ("bear", 0.4)], "bullish", [1.2, 1.0]),
        ([("bear", 1.2), ("bear", 1.0), ("bull", 0.4)], "bearish", [1.2, 1.0]),
        ([("bull", 1.2), ("bear", 1.0)], "neutral", []),
        ([("bull", 1.0)], "neutral", []),
        ([], "neutral", []),
    ],
)
def test_stance_vectors(spark, weights, stance, top):
    rows = [("X", i, f"r{i}", "d", s, w) for i, (s, w) in enumerate(weights)]
    sig = frame(spark, rows, "symbol string, ord int, rule string, data_type string, side string, weight double")
    sig = sig.withColumn("weight", F.col("weight").cast("decimal(6,2)"))
    got = signals.stance(sig, frame(spark, [("X",)], "symbol string"))
    assert got.first().stance == stance
    assert [r.weight for r in signals.drivers(sig, got).orderBy("rank").collect()] == top


METRICS = (
    "symbol string, return_pct double, trend string, aligned boolean, rsi double, volume_spike boolean, funding_bias string, "
    "ratio_bias string, sentiment string, fear_greed double, risk_appetite string, announcements int, change_30d double, tvl_direction string"
)


def test_rules_fire_once_and_null_fires_none(spark):
    row = ("X", 8.2, "bullish_aligned", False, 50.0, False, "balanced", "long_dominant", "mixed", 50.0, "stable", 1, None, "unknown")
    nothing = ("Y", *[None] * 13)
    got = signals.signal_inventory(frame(spark, [row, nothing], METRICS)).collect()
    assert [(r.rule, r.side, float(r.weight)) for r in got] == [
        ("1a", "bull", 1.0), ("2a", "bull", 1.2), ("3", "neutral", 1.0), ("6c", "neutral", 0.5), ("7a", "bear", 0.9), ("9c", "neutral", 0.5), ("11", "neutral", 0.4),
    ]
    out = signals.stance(signals.signal_inventory(frame(spark, [row], METRICS)), frame(spark, [("X",)], "symbol string")).first()
    assert (out.bull_weight, out.bear_weight, out.net_margin_pct, out.stance) == (2.2, 0.9, 41.9, "bullish")
    failures = frame(spark, [("X", False)], "symbol string, is_fallback boolean")
    stances = signals.stance(signals.signal_inventory(frame(spark, [row], METRICS)), frame(spark, [("X",)], "symbol string"))
    assert signals.confidence(stances, failures).first().confidence == 0.55


def test_every_source_has_one_agent_and_fallbacks_are_weak(spark):
    assert len({s[1] for s in evidence.SOURCES}) == len(evidence.SOURCES)
    seen = frame(spark, [("X", "market", "E1", 0.9, "success"), ("X", "tvl", "E2", 0.75, "unsupported")], "symbol string, label string, evidence_id string, reliability double, status string")
    got = evidence.complete(seen, frame(spark, [("X",)], "symbol string"), evidence.sources(spark)).orderBy("ordinal").collect()
    assert [r.label for r in got] == [s[1] for s in evidence.SOURCES]
    assert all(r.reliability == 0.2 and r.evidence_id.endswith("-FALLBACK") for r in got if r.is_fallback) and got[0].evidence_id == "E1"
    assert got[10].status == "unsupported" and got[1].status == "unavailable"


def test_quality_findings_and_dangling(spark):
    good = ("E1", "s", "u", "2026-01-01T00:00:00Z", "market", "X", "14d", "{}", 0.9, "r", "c")
    rows = [good, good, ("E2", "", "u", "never", None, "X", "14d", "{}", 1.2, "", "c")]
    got = sorted((r.evidence_id, r.finding) for r in evidence.quality_findings(frame(spark, rows, evidence.SCHEMA)).collect())
    assert got == [("E1", "duplicate id"), ("E2", "bad timestamp"), ("E2", "empty source"), ("E2", "empty traceability"), ("E2", "missing data_type"), ("E2", "score out of range")]
    refs = frame(spark, [("E1",), ("E9",)], "evidence_id string")
    assert [r[0] for r in evidence.dangling(refs, frame(spark, rows, evidence.SCHEMA), "evidence_id").collect()] == ["E9"]


def test_ledger(spark):
    rows = [("A", "1", "w", 5.0), ("A", "2", "v", 9.0), ("A", "3", "w", 7.0), ("A", "3", "new", 1.0), ("B", "1", "w", 2.0)]
    ledger = frame(spark, rows, "coin string, fetched_at string, label string, balance double")
    got = {(r.coin, r.label): (r.previous_at, r.previous, r.delta) for r in evidence.snapshot_delta(ledger).collect()}
    assert got == {("A", "w"): ("1", 5.0, 2.0), ("A", "new"): ("1", None, None), ("B", "w"): (None, None, None)}
    many = frame(spark, [("A", f"{i:03d}", "w", 1.0) for i in range(31)], "coin string, fetched_at string, label string, balance double")
    kept = evidence.keep_newest(many)
    assert kept.count() == 30 and kept.where("fetched_at = '000'").count() == 0


def test_requests(spark):
    rows = [(" btc ", "why?"), ("DOGE", ""), ("ETH", "  "), ("ETH", "x" * 501), (None, None)]
    got = frame(spark, rows, "coin string, q string").select(evidence.request_error("coin", "q").alias("e")).collect()
    assert [r.e for r in got] == [None, "unsupported symbol", "question is empty", "question is too long", "unsupported symbol"]


def test_text_functions(spark):
    t = frame(spark, [("<p>Fed  holds &amp; waits</p>",), ("word " * 300,), (None,), ("One. " * 90,)], "raw string")
    a, b, c, d = [r.x for r in t.select(text.strip_html("raw").alias("x")).collect()]
    assert a == "Fed holds & waits" and len(b) <= 421 and b.endswith("…") and c == "" and d.endswith(".…")
    names = frame(spark, [("Ethereum rallies",), ("Cardano falls",), (None,)], "t string")
    assert [r.m for r in names.select(text.mentions("t", ["eth", "ethereum"]).alias("m")).collect()] == [True, False, False]
    page = "<nav><p>" + "menu " * 40 + "</p></nav><p>" + "$A 1% " * 30 + "</p><p>" + "prose goes here " * 10 + "</p><p>short</p>"
    got = frame(spark, [(page,), (None,)], "html string").select(text.article_text("html").alias("b")).collect()
    assert got[0].b == ("prose goes here " * 10).strip() and got[1].b == ""
    posts = frame(spark, [("k", "Up, up and up! (moon)"), ("k", "down"), ("j", None)], "key string, t string")
    mood = {r.key: (r.positive_terms, r.negative_terms, r.sentiment) for r in text.lexicon_sentiment(posts, ["key"], "t", ["up", "moon"], ["down"]).collect()}
    assert mood == {"k": (2, 1, "positive"), "j": (0, 0, "mixed")}


def test_payloads(spark):
    one = lambda body: frame(spark, [(json.dumps(body),)], "body string")
    assert [payloads.funding(one({"lastFundingRate": r}), "body").first()[:] for r in ("0.0005", "-0.0007")] == [(0.05, "long_crowded"), (-0.07, "short_crowded")]
    k = payloads.klines(one([[1, "1", "3", "0.5", "2", "9"], [1, "1", "3", "0.5", "2", "9"], [2, "2", "3", "1", "x", "4"]]), "body")
    assert sorted((r.open_time_ms, r.high, r.close) for r in k.collect() if r.close) == [(1, 3.0, 2.0)] and k.count() == 2
    m = payloads.market_series(one({"prices": [[0, 100.0], [86400000, 108.2]], "total_volumes": [[0, 1.0]]}), "body").first()
    assert (m.return_pct, m.dates, m.volumes) == (8.2, ["1970-01-01", "1970-01-02"], None)
    w = frame(spark, [(hex(731 * 10**18),), (hex(123456789012345678901234567890),)], "h string").select(payloads.hex_wei("h").alias("e")).collect()
    assert w[0].e == 731.0 and w[1].e == pytest.approx(123456789012.3457)
    balance = payloads.wallet_balances(one({"a": {"final_balance": 1234567890123}, "z": {"final_balance": 1}}), frame(spark, [("a", "cold")], "address string, label string"), "body")
    assert [(r.label, r.balance) for r in balance.collect()] == [("cold", 12345.6789)]
    ratios = frame(spark, [("X", i, r) for i, r in enumerate([1.5, 0.667, 1.5])], "k string, t int, r double")
    assert payloads.side_consistency(ratios, "k", "t", "r").first()[:] == ("X", 1.5, "long_dominant", 66.7)
    tvl = frame(spark, [("X", i, 100.0 + i) for i in range(40)] + [("Y", 0, 1.0)], "k string, t int, v double")
    assert payloads.trend(tvl, "k", "t", "v").first()[:] == ("X", 139.0, 39.0, 27.52, "expanding")
    beats = frame(spark, [('{"result":"0x10"}',), ('{"height":7}',), ('{"error":"e","result":"0x1"}',)], "body string")
    assert sorted(r.height for r in payloads.heartbeat(beats, "body").collect()) == [7, 16]


def test_profiles_keep_missing_null(spark):
    p = frame(spark, [("A", 2.0), ("B", 1.0), ("C", None), ("D", None), ("E", 2.0)], "symbol string, v double")
    got = {(r.a, r.b): (r.leader, r.verdict, r.ratio) for r in compare.pairwise(p, frame(spark, list(itertools.combinations("ABCDE", 2)), "a string, b string"), "v").collect()}
    assert got["A", "B"] == ("A", "leads", 2.0) and got["A", "C"] == ("A", "only one known", None)
    assert got["C", "D"] == (None, "unknown", None) and got["A", "E"] == (None, "tie", None)
    bars = fixtures.fixture_bars(spark)
    liq = {r.symbol: (r.avg_volume, r.volume_trend_pct) for r in compare.liquidity(bars).collect()}
    assert all(t == 6.0 for _, t in liq.values())
    m = frame(spark, [("A", None, None, None, None)], "symbol string, funding_pct double, long_pct double, rsi double, aligned boolean")
    r = compare.risk_composite(m, frame(spark, [], "symbol string, realised_volatility double")).first()
    assert r.components_available == 0 and r.composite_score is None


def test_windows_and_files(spark, tmp_path):
    bars = fixtures.fixture_bars(spark)
    w = indicators.price_windows(bars)
    assert w.count() == 20 and {r.return_pct for r in w.collect()} == {7.8}
    sinks.write_bars(bars, str(tmp_path / "out"))
    csv = next((tmp_path / "out/bars/symbol=BTC").glob("*.csv"))
    back = tables.read_ohlcv_csv(spark, str(csv), "btc", 5).orderBy("idx").collect()
    assert [r.idx for r in back] == [0, 1, 2, 3, 4] and back[-1].symbol == "BTC" and back[-1].close == 646.8
    (tmp_path / "bad.csv").write_text("﻿date,open\n1,2\n")
    with pytest.raises(tables.BadBars, match="missing"):
        tables.read_ohlcv_csv(spark, str(tmp_path / "bad.csv"))


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    events = tables.read(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    run_bars(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = tables.event_bars(tables.read(spark, "/root/testdata/sf0.001", "events"))
    keyed = got.withColumn("bar", F.date_format("start", "yyyy-MM-dd HH:mm")).select("symbol", "bar", "open", "high", "low", "close", "volume", "n")
    assert keyed.count() > 0.9 * batch.count()
    assert keyed.exceptAll(batch.select(*keyed.columns)).count() == 0


def test_plans_prune_and_push_down(spark, capsys):
    tables.region_bars(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "l_comment" not in plan and "ReadSchema: struct<l_suppkey" in plan and "BroadcastHashJoin" in plan


def test_comparison_with_a_missing_side(spark):
    schema = "symbol string, avg_volume double, composite_score double, engagement long, news long, posts long, capped boolean"
    profiles = frame(spark, [("A", 10.0, None, 5, 1, 2, False), ("B", 30.0, None, 5, 6, 2, True)], schema)
    got = {(r.a, r.b): r for r in compare.comparison(profiles, frame(spark, [("A", "B"), ("A", "Z"), ("Y", "Z"), ("A", "A")], "a string, b string")).collect()}
    assert set(got) == {("A", "B"), ("A", "Z"), ("Y", "Z")}
    ab = got["A", "B"]
    assert (ab.liquidity_leader, ab.liquidity_ratio, ab.risk_verdict, ab.attention_verdict) == ("B", 3.0, "unknown", "tie")
    assert ab.note and "| risk | N/A | N/A | unknown |" in ab.report
    assert (got["A", "Z"].liquidity_leader, got["A", "Z"].liquidity_ratio) == ("A", None)
    assert got["Y", "Z"].summary == "too little data to tell them apart"


def test_news_union_of_odd_items(spark):
    schema = "coin string, title string, n int"
    ours = frame(spark, [("A", "One", 1), ("A", "ONE", 2), ("A", "", 3), ("A", None, 4), (None, "One", 5)], schema)
    theirs = frame(spark, [("A", "one", 1), ("A", "two", 2), ("A", "two", 3), ("A", None, 4), ("A", "five", 5), ("A", "late", 6), (None, "one", 7)], schema)
    got = [tuple(r) for r in evidence.news_union(ours, theirs, "coin", "title", "n").orderBy("coin", "rank").select("coin", "n", "from_publisher", "rank").collect()]
    assert got == [(None, 5, True, 1), ("A", 1, True, 1), ("A", 2, False, 2), ("A", 3, False, 3), ("A", 4, False, 4), ("A", 5, False, 5)]
    assert evidence.news_union(ours.limit(0), theirs.limit(0), "coin", "title", "n").count() == 0


def test_sentence_blocks_fuller_texts_and_numbers(spark):
    rows = [("Short. one; two! three and a good deal more text? end",), ("",), (None,), ("no end at all",), ("a long clause that stands alone; tail",)]
    got = [r[0] for r in frame(spark, rows, "t string").select(text.sentence_blocks("t")).collect()]
    assert got == [["Short. one;two!three and a good deal more text?end"], [""], [""], ["no end at all"], ["a long clause that stands alone;tail"]]
    pairs = frame(spark, [("a b", "x a  b y"), ("same", "same "), ("a", "b"), (None, "c")], "p string, q string")
    assert [r[0] for r in pairs.select(text.fuller("p", "q")).collect()] == ["x a  b y", "same", None, "c"]
    assert frame(spark, [(["1", "x", None, "2.5"],)], "s array<string>").select(evidence.numeric_elements("s")).first()[0] == [1.0, 2.5]


def test_narrative_without_signals(spark):
    none = frame(spark, [], "symbol string, ord int, rule string, data_type string, side string, weight decimal(6,2)")
    stances = signals.stance(none, frame(spark, [("X",)], "symbol string"))
    found = frame(spark, [("X", 0, "market", "E", True)], "symbol string, ordinal int, label string, evidence_id string, is_fallback boolean")
    sure = signals.confidence(stances, found)
    got = {(r.section, r.ord) for r in reasoning.narrative(none, stances, sure, found, frame(spark, [("X", None)], "symbol string, fear_greed double")).collect()}
    assert got == {("judgment", 1), ("facts", 0), ("inferences", 20), ("counter_evidence", 300), ("counter_evidence", 400), ("observations", 4)}
