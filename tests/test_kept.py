"""Budgets of crawls, roll-ups, and runs that are repeated."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import crawl, signals
from tidemark.plans import sinks


def brute(items, budget):
    """(id, status, fetched before) as a crawl that stops at its budget leaves them."""
    out, count = set(), {}
    for n, key, place, status in sorted(items, key=lambda r: (r[2] is None, r[2] or 0)):
        before = count.setdefault(key, 0)
        out.add((n, status if before < budget else None, before))
        count[key] += status in ("ok", "empty")
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_budget_ends_a_list_in_the_middle(spark, monkeypatch, block):
    monkeypatch.setattr(crawl, "BLOCK", block)
    rng = random.Random(3)
    places = {key: list(range(n)) for key, n in (("a", 40), ("b", 9), (None, 25), ("c", 1))}
    items = [(f"{key}{at}", key, at, rng.choice(["ok", "empty", "failed:X", "skipped:robots"])) for key, own in places.items() for at in own] + [("last", "a", None, "ok")]
    df = spark.createDataFrame([(*i, "x") for i in items], "id string, list string, place long, status string, _block string")
    found = crawl.within_budget(df.drop("_block"), "list", "place", "status")
    assert {(r.id, r.status, r.fetched_before) for r in found.collect()} == brute(items, 8)
    assert found.columns == ["id", "list", "place", "status", "fetched_before"]
    assert crawl.within_budget(df.drop("_block").limit(0), "list", "place", "status").count() == 0


def test_statuses_name_the_error(spark):
    rows = [("https://www.a.com/x", True, None, False, "HTTPError"), ("https://a.com", True, None, False, None), ("https://a.com", None, "t", False, None), ("https://b.com", True, "t", False, None),
            ("https://a.com", True, "t", True, None), ("https://a.com", True, " ", False, None), (None, True, "t", False, None), ("https://a.com", True, "t", False, "E")]
    df = spark.createDataFrame(rows, "url string, robots boolean, body string, late boolean, error string")
    want = ["failed:HTTPError", "failed", "skipped:robots", "skipped:not_whitelisted", "skipped:deadline", "empty", "skipped:not_whitelisted", "ok"]
    assert [r[0] for r in df.select(crawl.statuses(["a.com"])).collect()] == want


def test_rollup_levels(spark):
    rows = [("A", "bull", "m", 1.0), ("A", "bull", "m", 0.5), ("A", "bear", "n", 2.0), ("B", None, "m", None)]
    x = signals.rollup(spark.createDataFrame(rows, "symbol string, side string, data_type string, weight double"))
    by = {(r.symbol, r.side, r.data_type, r.level): (r.signals, r.weight) for r in x.collect()}
    assert by["A", "bull", "m", 0] == (2, 1.5) and by["A", "bear", None, 1] == (1, 2.0) and by[None, "bull", "m", 4] == (2, 1.5)
    assert by[None, None, None, 7] == (4, 3.5) and by[None, None, None, 5] == (1, 0.0) and by["B", None, "m", 0] == (1, 0.0)


def files(path: Path):
    return sorted((str(p.parent.relative_to(path)), len(p.read_bytes())) for p in path.rglob("part-*"))


def test_written_twice_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("A", "e1", 1), ("A", "e2", 2), ("B", "e3", 3)], "coin string, evidence_id string, n int")
    sinks.write_evidence(rows, str(tmp_path))
    before = files(tmp_path)
    sinks.write_evidence(rows, str(tmp_path))
    assert files(tmp_path) == before
    sinks.write_evidence(rows.where("coin = 'A'").withColumn("n", F.lit(9)), str(tmp_path))
    got = spark.read.json(str(tmp_path)).select("coin", "evidence_id", "n").collect()
    assert sorted(map(tuple, got)) == [("A", "e1", 9), ("A", "e2", 9), ("B", "e3", 3)]


def stored(spark, path):
    return sorted(map(tuple, spark.read.schema(sinks.LEDGER).parquet(path).select("coin", "fetched_at", "label", "balance").collect()))


def test_ledger_is_cut_replaced_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *r: spark.createDataFrame(list(r), "coin string, fetched_at string, label string, balance double, extra int")
    sinks.store_snapshots(rows(*[("A", f"{k:02}", "x", float(k), 0) for k in range(33)], ("B", "01", "y", 1.0, 0)), path)
    assert len(stored(spark, path)) == 31 and stored(spark, path)[0] == ("A", "03", "x", 3.0)
    for _ in range(2):
        sinks.store_snapshots(rows(("A", "40", "x", 40.0, 0), ("A", "32", "z", -1.0, 0), ("A", "32", "z", -1.0, 0), ("A", "00", "x", 0.0, 0)), path)
        got = stored(spark, path)
        assert len(got) == 31 and got[0] == ("A", "04", "x", 4.0) and got[-3:] == [("A", "32", "z", -1.0), ("A", "40", "x", 40.0), ("B", "01", "y", 1.0)]
    sinks.store_snapshots(rows(), path)
    assert stored(spark, path) == got


def test_a_batch_that_runs_again_replaces_its_folder(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), tmp_path / "check"
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    sinks.store_batches(stream(), out, str(check)).awaitTermination()
    for name in ("0", ".0.crc"):
        (check / "commits" / name).unlink()  # as if the driver was lost between the write and the commit
    sinks.store_batches(stream(), out, str(check)).awaitTermination()
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sinks.store_batches(stream(), out, str(check)).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "batch").collect()) == [(k, int(k > 4)) for k in range(8)]
