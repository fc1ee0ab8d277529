"""Records: the fixture's signals, facts of content that is whole, empty and broken, stand-ins, and repeats of a type."""

import json

import pytest

from tidemark.operators import records, rules, signals
from tidemark.sources import fixtures

SCHEMA = "symbol string, ordinal int, data_type string, evidence_id string, content string"


def fact(spark, kind, content):
    text = content if content is None or isinstance(content, str) else json.dumps(content)
    df = spark.createDataFrame([("A", 0, kind, "EV-1", text)], SCHEMA)
    return records.facts(df).first().fact


def test_signals_of_the_fixture(spark):
    x = records.metrics_of_records(fixtures.fixture_records(spark))
    fired = rules.fired(x, rules.built_in(spark))
    assert {r.rule for r in fired.where("symbol = 'ETH'").collect()} == {"1a", "2a", "3", "6c", "7a", "9c", "11"}
    s = signals.stance(fired, x).where("symbol = 'ETH'").first()
    assert (s.bull_weight, s.bear_weight, s.signal_count, s.stance, s.net_margin_pct) == (2.2, 0.9, 7, "bullish", 41.9)


def test_records_of_the_fixture(spark):
    rows = {r.data_type: r for r in fixtures.fixture_records(spark).where("symbol = 'SOL'").collect()}
    market = json.loads(rows["market"].content)
    assert len(rows) == 9 and market["prices"][0] == 140.0 and len(market["dates"]) == 14 and market["return_pct"] == 8.2
    said = {r.data_type: r.fact for r in records.facts(fixtures.fixture_records(spark).where("symbol = 'SOL'")).collect()}
    assert said["whale"] == "EV-005: known wallets hold Demo Exchange Wallet 500,000"
    assert said["social"] == "EV-003: the mood is mixed (for: adoption; against: drop)"
    assert said["macro"] == 'EV-008: fear and greed is 52 (Neutral), +5 in 14 days; latest policy release "Federal Reserve issues FOMC statement"'
    assert said["vegas_channel"] == "EV-006: the trend is bullish_aligned, RSI 48.0, volume is usual, no signal yet, timeframes disagree".replace("48.0", "48")


@pytest.mark.parametrize("content", [None, "{", "[]", "{}", '{"items": 5, "posts": {}, "wallets": "x", "current": [], "4h": null}'])
def test_content_that_lacks_everything(spark, content):
    want = {
        "market": "the price moved N/A % over the period", "news": "there are no headlines", "social": "the mood is unknown (no telling words)", "derivatives": "funding is not known",
        "whale": "no wallets are known", "vegas_channel": "the channel is not known", "long_short_ratio": "the ratio is not known", "macro": "fear and greed is not known",
        "announcement": "there are no announcements", "tvl": "tvl was observed",
    }
    for kind, said in want.items():
        assert fact(spark, kind, content) == f"EV-1: {said}"


def test_titles_are_cut_and_counted(spark):
    items = [{"title": "x" * 80}, {"title": ""}, {"url": "u"}, {"title": "b"}, {"title": "c"}, {"title": "d"}]
    assert fact(spark, "announcement", {"items": items, "first_party": False}) == f'EV-1: 6 announcements from syndicated news: "{"x" * 50}"; "b"'
    assert fact(spark, "news", {"items": items}) == f'EV-1: recent headlines are "{"x" * 80}"; "b"; "c"'


def test_stand_ins(spark):
    lost = spark.createDataFrame([("A", "macro", "unavailable", "HTTPError"), ("A", "onchain", "unsupported", "NotImplementedError"), ("A", "nothing", "unavailable", "E")], "symbol string, data_type string, status string, reason string")
    rows = {r.data_type: r for r in records.fallback_records(lost, spark).collect()}
    assert set(rows) == {"macro", "onchain"} and rows["macro"].reliability_score == 0.2
    assert json.loads(rows["macro"].content) == {"status": "unavailable", "reason": "HTTPError", "fear_greed_history": [], "fed_releases": [], "risk_appetite_direction": "unknown"}
    assert json.loads(rows["onchain"].content) == {"status": "unsupported", "reason": "NotImplementedError"} and json.loads(rows["onchain"].content_reference)["fallback"] is True


def test_the_first_record_of_a_type_counts(spark):
    rows = [("A", 1, "market", "e", '{"return_pct": 1}'), ("A", 0, "market", "e", '{"return_pct": 5}'), ("A", 0, "market", "e", '{"return_pct": 5}'), ("A", 2, "long_short_ratio", "e", '{"bias": "long_dominant"}'), ("B", 0, "announcement", "e", "{")]
    found = {r.symbol: r for r in records.metrics_of_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["A"].return_pct == 5 and found["A"].ratio_bias is None and found["B"].announcements is None
