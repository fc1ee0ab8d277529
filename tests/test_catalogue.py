"""Catalogue queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.operators import backtest, compare
from tidemark.plans import catalogue, cited, kept, landed, oracle, recorded, ruled, series, streams
from tidemark.sources import shared

SF = "/root/testdata/sf0.001"
MODULES = [series, landed, streams, ruled, cited, kept, recorded]
QUERIES = catalogue.QUERIES | {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = oracle.ORACLE_SQL | {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
QUICK = [
    "bars_from_events", "bars_daily_region", "price_windows", "downsample", "rsi", "crossovers", "strategy_signals", "side_consistency", "trend_30_90",
    "pairwise_compare", "fallback_fill", "dq_rules", "dedupe_topn", "snapshot_delta", "lexicon_sentiment", "strip_truncate", "article_text", "citations",
    "report_markdown", "narrative", "risk_factors", "comparison_report", "news_union", "policy_releases", "evidence_by_type", "footnotes", "indicators_shown",
    "run_state", "numeric_elements", "sentence_blocks", "fuller_text", "minutes_shown", "scan_signals", "scan_ticks", "bulk_klines", "market_payloads",
    "funding_payloads", "kline_payloads", "heartbeats", "social_posts", "social_profile", "live_evidence", "wallet_balances", "announcements", "ratio_history",
    "number_formats", "ledger_stream", "sliding_windows", "session_windows", "session_stream", "signal_rules", "rule_table", "linked_lines", "alias_mentions",
    "crawl_budget", "signal_rollup", "stored_bars", "stored_ledger", "evidence_facts", "signals_of_records", "fallback_records", "agent_rollup", "agents_once",
    "elided_series",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in sql.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert got == want


def test_entry_and_names(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    names = [n for m in [catalogue, *MODULES] for n in m.QUERIES]
    assert len(names) == len(set(names)) and set(names) <= set(driver.queries())
    assert set(names) <= set(driver.oracle_sql())
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["backtest_summary", "report_markdown", "comparison_report"])
def test_line_items_are_read_once(spark, monkeypatch, name):
    plans = []

    def recorded(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.staged(df, label)

    for module in (catalogue, compare, backtest):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", recorded)
    plans.append(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("lineitem.parquet") for p in plans) == 1


def test_scratch_deletes_what_was_staged_in_it(spark):
    with shared.scratch(spark):
        found = shared.staged(spark.range(3), "some")
        path = Path(found.inputFiles()[0].removeprefix("file://")).parent
        assert found.count() == 3 and path.exists()
    assert not path.exists() and path.parent.exists()
