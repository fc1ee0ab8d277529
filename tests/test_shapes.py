"""Payloads of several shapes: error envelopes, broken JSON, absent fields, and the providers' own counters."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbers import cell, series_texts, signed
from tidemark.sources import shapes


@pytest.mark.parametrize(
    "symbol, body, height, status",
    [
        ("eth", '{"result": "0x10"}', 16, "ok"), ("ETH", '{"result": "0x10", "error": {"code": 1}}', None, "failed"), ("BNB", '{"result": ""}', None, "failed"),
        ("BNB", '{"result": "0xzz"}', None, "failed"), ("ETH", "{", None, "failed"), ("ETH", None, None, "failed"), ("ETH", "[]", None, "failed"), ("ETH", '{"result": "0x10", "error": null}', None, "failed"),
        ("BTC", " 840000\n", 840_000, "ok"), ("BTC", "<html>", None, "failed"), ("SOL", '{"result": {"epoch": 700}}', 700, "ok"), ("SOL", '{"result": {}}', None, "failed"),
        ("XRP", '{"result": {"ledger_current_index": 9}}', 9, "ok"), ("XRP", '{"result": {"ledger_current_index": 0}}', None, "failed"), ("DOGE", "1", None, "unsupported"), (None, "1", None, "unsupported"),
    ],
)
def test_heartbeats(spark, symbol, body, height, status):
    df = spark.createDataFrame([(symbol, body, 1)], "symbol string, body string, n int")
    r = shapes.heartbeats(df, "symbol", "body").first()
    assert (r.height, r.status, r.n) == (height, status, 1)


def test_posts_of_three_providers(spark):
    reddit = {"data": {"children": [{"data": {"title": "Bullish! SURGE (drop) bullish", "permalink": "/r/1", "created_utc": 5, "score": 3, "num_comments": 2}}, {"data": {}}, {}]}}
    bluesky = {"posts": [{"uri": "at://a/b/key", "author": {"handle": "h"}, "record": {"text": "x" * 600 + " crash"}, "likeCount": 1, "replyCount": 2, "repostCount": 3}, {"uri": "", "author": {"handle": "h"}}]}
    hn = {"hits": [{"objectID": "7", "title": None, "story_title": "", "comment_text": "an upgrade", "points": 4, "num_comments": None}, {"title": "t", "url": "u"}]}
    many = {"posts": [{"record": {"text": str(k)}} for k in range(40)]}
    rows = [("reddit", json.dumps(reddit)), ("bluesky", json.dumps(bluesky)), ("hackernews", json.dumps(hn)), ("bluesky", json.dumps(many)), ("reddit", "{"), ("bluesky", json.dumps({"posts": 5})), ("other", json.dumps(hn)), ("reddit", None)]
    df = spark.createDataFrame([(k, p, b) for k, (p, b) in enumerate(rows)], "k int, provider string, body string")
    posts = shapes.social_posts(df, "provider", "body")
    by = {(r.k, r.n): r for r in posts.collect()}
    assert {k for k, _ in by} == {0, 1, 2, 3} and len(by) == 3 + 2 + 2 + 25
    assert (by[0, 0].positive, by[0, 0].negative, by[0, 0].score, by[0, 0].comments, by[0, 0].at, by[0, 0].likes) == (["bullish", "surge"], ["drop"], 3, 2, "5", None)
    assert by[0, 1].text == "" and by[0, 2].url == "https://www.reddit.com"
    assert (len(by[1, 0].text), by[1, 0].negative, by[1, 0].url, by[1, 1].url) == (500, ["crash"], "https://bsky.app/profile/h/post/key", "")
    assert (by[2, 0].text, by[2, 0].url, by[2, 0].points, by[2, 0].comments, by[2, 1].url) == ("an upgrade", "https://news.ycombinator.com/item?id=7", 4, None, "u")
    profile = {r.k: r for r in shapes.social_profile(posts, ["k"]).collect()}
    assert (profile[1].engagement, profile[1].sentiment, profile[0].sentiment, profile[3].capped) == (6, "negative", "positive", True)


@pytest.mark.parametrize("mark, live", [("true", False), ("false", True), ("null", True), ("0", True), ("0.0", True), ("2", False), ('"0"', False), ('""', True), ("[]", True), ("[0]", False), ("{}", True), ('{"a": 1}', False)])
def test_fallback_marks(spark, mark, live):
    df = spark.createDataFrame([(f'{{"fallback": {mark}}}',)], "ref string")
    assert df.select(shapes.is_live("ref")).first()[0] is live


def test_records_without_a_mark(spark):
    df = spark.createDataFrame([(None,), ("{}",), ("{broken",), ("[1]",)], "ref string")
    assert [r[0] for r in df.select(shapes.is_live("ref")).collect()] == [False, True, True, True]


def test_wallets(spark):
    known = {c: [a for s, _, a in shapes.WALLETS if s == c] for c in ("BTC", "ETH", "BNB")}
    btc = json.dumps({known["BTC"][0]: {"final_balance": 123456789}, known["BTC"][1]: {"final_balance": 0}, "other": {}})
    answers = [("BTC", "", btc), ("ETH", known["ETH"][0], '{"result": "0x0de0b6b3a7640000"}'), ("ETH", known["ETH"][1], '{"result": "0x"}'), ("BNB", known["BNB"][0], '{"result": "0x1bc16d674ec80000"}'), ("BNB", known["BNB"][1], '{"result": "0x0"}'), ("BNB", "unknown", '{"result": "0x1"}')]
    asked = spark.createDataFrame([("BTC",), ("eth",), ("BNB",), ("XRP",), ("btc",)], "symbol string")
    rows = shapes.balances(asked, spark.createDataFrame(answers, "symbol string, address string, body string"), shapes.wallets(spark)).collect()
    got = sorted((r.symbol, r.status, r.balance) for r in rows if r.balance is not None or r.label is None)
    assert got == [("BNB", "ok", 0.0), ("BNB", "ok", 2.0), ("BTC", "ok", 0.0), ("BTC", "ok", 1.2346), ("XRP", "unsupported", None)]
    assert {r.status for r in rows if r.symbol == "ETH"} == {"failed"} and len(rows) == 7


def test_ratio_points_are_rounded_before_they_are_compared(spark):
    body = json.dumps([{"longAccount": "0.5", "shortAccount": "0.5", "longShortRatio": "1.00004"}, {"longAccount": "x", "shortAccount": "0.4", "longShortRatio": "1.02004"}])
    df = spark.createDataFrame([(1, body), (2, "[]"), (3, "{"), (4, None)], "k int, body string")
    r = shapes.ratio_history(df, "body").collect()
    assert len(r) == 1 and (r[0].points, r[0].long_pct, r[0].ratio, r[0].bias, r[0].consistency_pct) == (2, None, 1.02, "balanced", 50.0)


def test_formats(spark):
    df = spark.createDataFrame([(1234567.5, 1234567, [1.0, None, 1e6]), (None, None, [1.5, 2.0]), (-0.5, -3, [])], "x double, n long, v array<double>")
    kinds = dict(df.dtypes)
    rows = df.select(cell(kinds, "x"), cell(kinds, "n"), signed("x"), F.array_join(series_texts("v", "%"), "|")).collect()
    assert [tuple(r) for r in rows] == [("1,234,567.50", "1,234,567", "+1,234,567.50%", "1%|N/A|1,000,000%"), ("N/A", "N/A", "N/A", "1.50%|2.00%"), ("-0.50", "-3", "-0.50%", "")]
