"""Rules as rows: the range join against plain loops, ends, classes of width, and a plan that rules do not lengthen."""

import random
from decimal import Decimal

import pytest

from tidemark.operators import rules, signals

METRICS = "symbol string, a double, b long, flag boolean, word string, other string"


def row(rule, part, metric, low=None, low_in=True, high=None, high_in=True, text=None):
    return (1, rule, "d", "bull", Decimal("1.00"), part, metric, low, low_in, high, high_in, text)


def holds(r, metrics):
    _, _, _, _, _, _, metric, low, low_in, high, high_in, text = r
    v = metrics.get(metric)
    if v is None or v != v:
        return False
    if text is not None:
        return v == text
    if low is None and high is None:
        return True
    if isinstance(v, str):
        return False
    return (low is None or v > low or low_in and v == low) and (high is None or v < high or high_in and v == high)


def brute(metrics, table):
    out = set()
    for m in metrics:
        for name in {r[1] for r in table}:
            own = [r for r in table if r[1] == name]
            if all(any(holds(r, m) for r in own if r[5] == part) for part in {r[5] for r in own}):
                out.add((m["symbol"], name))
    return out


def result(spark, metrics, table):
    df = spark.createDataFrame([tuple(m.get(c.split()[0]) for c in METRICS.split(", ")) for m in metrics], METRICS)
    found = rules.fired(df, spark.createDataFrame(table, rules.SCHEMA)).select("symbol", "rule").collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_against_plain_loops(spark):
    rng = random.Random(9)
    points = [0.0, -1.0, 1.0, 2.0, 1e-12, 1e12, -1e300, 1e300, 0.1, 20.0, float("inf"), 2.0**40]
    metrics = [{"symbol": f"s{k}", "a": rng.choice([*points, rng.uniform(-50, 50), None, float("nan")]), "b": rng.choice([None, 0, 5, 2**40]), "flag": rng.choice([None, True, False]), "word": rng.choice([None, "", "x", "y"])} for k in range(120)]
    table = []
    for k in range(300):
        for part in range(rng.choice([1, 1, 2, 3])):
            for _ in range(rng.choice([1, 1, 2])):
                metric = rng.choice(["a", "a", "a", "b", "flag", "word", "absent"])
                if metric == "word":
                    table.append(row(f"r{k}", part, "word", text=rng.choice(["x", "", "z"])))
                    continue
                low, width = rng.choice([*points, rng.uniform(-50, 50)]), rng.choice([0.0, 1e-9, 1.0, 7.0, 1e6, -1.0])
                ends = rng.choice([(low, low + width), (low, low + width), (low, None), (None, low), (None, None)])
                table.append(row(f"r{k}", part, metric, ends[0], rng.random() < 0.5, ends[1], rng.random() < 0.5))
    want = brute(metrics, table)
    assert len(want) > 1000 and result(spark, metrics, table) == want


def test_odd_rows(spark):
    metrics = [{"symbol": "A", "a": 1.0}, {"symbol": "A", "a": 1.0}, {"symbol": None, "a": 2.0}]
    table = [row(None, 0, "a"), row("n", None, "a"), row("m", 0, None), row("far", 63, "a"), row("ok", 62, "a", 0.0)]
    assert result(spark, metrics, table) == {("A", "ok"), (None, "ok")}
    assert result(spark, [], table) == set()


def test_the_built_in_rules_are_those_of_the_expressions(spark):
    rng = random.Random(3)
    names = {"return_pct": [-3.0, -2.0, 0.0, 2.0, 2.5, None], "trend": ["bullish_aligned", "bearish_aligned", "mixed", None], "aligned": [True, False, None],
             "rsi": [10.0, 20.0, 50.0, 80.0, 81.0, None], "volume_spike": [True, False], "funding_bias": ["long_crowded", "short_crowded", "balanced", None],
             "ratio_bias": ["long_dominant", "short_dominant", "balanced"], "sentiment": ["positive", "negative", "mixed"], "fear_greed": [25.0, 26.0, 75.0, 74.9, None],
             "risk_appetite": ["deteriorating", "improving", "stable"], "announcements": [0, 1, 3], "change_30d": [None, 1.0], "tvl_direction": ["expanding", "contracting", "stable", "unknown", None]}
    schema = "symbol string, return_pct double, trend string, aligned boolean, rsi double, volume_spike boolean, funding_bias string, ratio_bias string, sentiment string, fear_greed double, risk_appetite string, announcements int, change_30d double, tvl_direction string"
    metrics = spark.createDataFrame([(f"s{k}", *[rng.choice(v) for v in names.values()]) for k in range(300)], schema)
    columns = ["symbol", "ord", "rule", "data_type", "side", "weight"]
    got = rules.fired(metrics, rules.built_in(spark)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, signals.signal_inventory(metrics).select(columns).collect()))


@pytest.mark.parametrize("few", [100_000, 10])
def test_ten_thousand_rules_leave_the_plan_as_it_is(spark, monkeypatch, few):
    monkeypatch.setattr(rules, "FEW", few)
    rng = random.Random(5)
    table = [row(f"r{k}", 0, "a", low := rng.uniform(0, 1000), True, low + rng.uniform(0, 0.2)) for k in range(10_000)]
    metrics = [{"symbol": f"s{k}", "a": rng.uniform(0, 1000)} for k in range(200)]
    df = spark.createDataFrame([(m["symbol"], m["a"], None, None, None, None) for m in metrics], METRICS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many, one = (rules.fired(df, spark.createDataFrame(t, rules.SCHEMA)) for t in (table, table[:1] * (few + 1 if few == 10 else 1)))
        nodes = [len(x._jdf.queryExecution().executedPlan().toString().splitlines()) for x in (many, one)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert nodes[0] == nodes[1]
    want = {(m["symbol"], r[1]) for m in metrics for r in table if r[7] <= m["a"] <= r[9]}
    assert {(r.symbol, r.rule) for r in many.collect()} == want


@pytest.mark.parametrize("few", [100_000, 10])
def test_a_part_that_holds_for_most_rows_is_not_joined_with_all_of_them(spark, monkeypatch, few):
    monkeypatch.setattr(rules, "FEW", few)
    joined = []
    monkeypatch.setattr(rules, "matched", lambda values, conditions, key="symbol", own=rules.matched: joined.append(own(values, conditions, key)) or joined[-1])
    metrics = [{"symbol": f"s{k}" if k else None, "a": float(k), "word": "x", "b": k} for k in range(1000)]
    table = []
    for k in range(0, 1000, 2):
        table += [row(f"r{k}", 0, "a", float(k), True, k + 1.5), row(f"r{k}", 1, "word", text="x"), row(f"r{k}", 2, "b"), row(f"r{k}", 3, "b", 0.0)]
        table += [row(f"r{k}", 4, "word", text="z"), row(f"r{k}", 4, "b", 0.0, True, 900.0)]
    got = result(spark, metrics, table)
    assert got == {(f"s{j}" if j else None, f"r{k}") for k in range(0, 1000, 2) for j in (k, k + 1) if j <= 900}
    assert sum(df.count() for df in joined) == 1000


@pytest.mark.parametrize("few", [100_000, 10])
def test_pairs_of_an_interval_and_one_more_condition_are_not_grouped(spark, monkeypatch, few):
    monkeypatch.setattr(rules, "FEW", few)
    monkeypatch.setattr(rules, "matched", lambda *rest: pytest.fail("pairs go through a shuffle"))
    rng = random.Random(11)
    metrics = [{"symbol": f"s{k}" if k else None, "a": rng.choice([None, float("nan"), 5.0, *(rng.uniform(0, 50) for _ in range(4))]), "b": rng.choice([None, 3, 7]), "flag": rng.choice([None, True, False]), "word": rng.choice([None, "x", "y"])} for k in range(120)]
    also = [[], [], [("word", None, None, "x")], [("b", 3.0, 5.0, None)], [("absent", 0.0, 1.0, None)], [("b", None, 6.0, None)], [("word", None, None, None)], [("flag", 1.0, None, None)]]
    table = []
    for k in range(200):
        low, part = rng.choice([5.0, rng.uniform(0, 50)]), rng.choice([0, 62])
        table.append(row(f"r{k}", part, "a", low, rng.random() < 0.5, low + rng.choice([0.0, 1e-9, 0.01, 0.2]), rng.random() < 0.5))
        table += [row(f"r{k}", 1, metric, a, True, b, True, text) for metric, a, b, text in rng.choice(also)]
    want = brute(metrics, table)
    assert want and result(spark, metrics, table + table[:1]) == want
