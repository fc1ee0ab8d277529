"""The ledger as a stream: against its batch form on replayed events, over restarts, and odd snapshots."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbers import rnd
from tidemark.operators import evidence
from tidemark.sources.tables import read
from tidemark.streaming import ledger

SF = "/root/testdata/sf0.001"


def arrive(spark, root, rows, **options):
    spark.createDataFrame(rows, ledger.SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{root}/in")
    ledger.run_ledger(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", **options)
    return sorted(map(tuple, spark.read.schema(ledger.DELTA).parquet(f"{root}/out").collect()), key=repr)


def test_state_is_kept_cut_and_replaced_over_restarts(spark, tmp_path):
    arrive(spark, tmp_path, [("A", "1", {"x": 1.0}), ("A", "2", {"y": 1.0}), ("A", "3", {"y": 2.0}), (None, "1", {"x": 1.0}), ("A", None, {"x": 9.0})], kept=2)
    arrive(spark, tmp_path, [("A", "3", {"x": 7.0, "y": None})], kept=2)
    found = arrive(spark, tmp_path, [("A", "4", {"x": 7.5, "y": 3.0}), ("B", "1", {}), ("A", "0", {"x": 0.0})], kept=2)
    assert set(found) == {
        ("A", "1", "x", 1.0, None, None, None), ("A", "2", "y", 1.0, None, None, None), ("A", "3", "y", 2.0, "2", 1.0, 1.0), (None, "1", "x", 1.0, None, None, None),
        ("A", "3", "x", 7.0, "2", None, None), ("A", "3", "y", None, "2", 1.0, None),  # again at the same time: compared with 2, then in place of the old 3
        ("A", "4", "x", 7.5, "3", 7.0, 0.5), ("A", "4", "y", 3.0, "3", None, None), ("A", "0", "x", 0.0, None, None, None),
    }


@pytest.fixture(scope="module")
def balances(spark):
    by = [F.col("event_type").alias("coin"), F.date_format("ts", "yyyy-MM-dd").alias("fetched_at"), F.concat(F.lit("w"), F.col("user_id") % 7).alias("label")]
    return read(spark, SF, "events").groupBy(*by).agg(rnd(F.sum("value"), 4).alias("balance"))


def test_newest_equals_the_batch_form_on_replayed_events(spark, balances, tmp_path):
    rows = balances.groupBy("coin", "fetched_at").agg(F.map_from_entries(F.collect_list(F.struct("label", "balance"))).alias("balances")).collect()
    days = sorted({r.fetched_at for r in rows})
    for part in (days[::2][:8], days):  # some days come a second time and replace themselves
        arrive(spark, tmp_path, [tuple(r) for r in rows if r.fetched_at in part])
    out = spark.read.schema(ledger.DELTA).parquet(f"{tmp_path}/out").distinct()
    newest = out.join(balances.groupBy("coin").agg(F.max("fetched_at").alias("fetched_at")), ["coin", "fetched_at"])
    want = evidence.snapshot_delta(evidence.keep_newest(balances))
    columns = ["coin", "fetched_at", "label", "balance", "previous_at", "previous", "delta"]
    assert sorted(map(tuple, newest.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
