"""Overlapping and session windows on streams: late rows up to the stated bound count, later ones are dropped."""

from datetime import datetime, timedelta

import pytest

from tidemark.streaming import windows

DAY = datetime(2024, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


def arrive(spark, root, rows, windowed, **options):
    """Files with events of (hours, user, type, value) arrive; the windows that are complete by then."""
    events = [(n, None if h is None else at(h), u, k, v, "") for n, (h, u, k, v) in enumerate(rows)]
    spark.createDataFrame(events, windows.EVENTS).coalesce(1).write.mode("append").parquet(f"{root}/in")
    windows.run(spark, windowed, f"{root}/in", f"{root}/out", f"{root}/checkpoint", **options)
    return spark.read.parquet(f"{root}/out").collect()


def test_sliding_windows_drop_what_is_later_than_the_bound(spark, tmp_path):
    options = dict(length="2 hours", slide="1 hour", late="3 hours")
    assert not arrive(spark, tmp_path, [(4.0, 1, "a", 1.0), (4.5, 1, "a", None), (None, 1, "a", 5.0)], windows.sliding, **options)  # watermark 1.5
    arrive(spark, tmp_path, [(10.0, 1, "a", 1.0)], windows.sliding, **options)  # 7.0
    arrive(spark, tmp_path, [(7.5, 1, "a", 10.0), (3.5, 1, "a", 100.0), (5.5, 1, "a", 1000.0)], windows.sliding, **options)  # in time, too late, too late
    found = {(r.start, r.n, r.total) for r in arrive(spark, tmp_path, [(20.0, 1, "b", 1.0)], windows.sliding, **options)}
    assert found == {(at(3), 2, 1.0), (at(4), 2, 1.0), (at(6), 1, 10.0), (at(7), 1, 10.0), (at(9), 1, 1.0), (at(10), 1, 1.0)}


def test_sessions_join_late_rows_within_the_bound_and_drop_the_rest(spark, tmp_path):
    options = dict(gap="1 hour", late="3 hours")
    arrive(spark, tmp_path, [(1.0, 1, "a", 1.0), (1.5, 1, "b", 1.0), (6.0, 1, "a", 1.0), (6.0, None, "a", 1.0)], windows.sessions, **options)  # watermark 3
    arrive(spark, tmp_path, [(5.2, 1, "c", 10.0), (1.2, 1, "c", 100.0)], windows.sessions, **options)  # joins 6.0; too late
    found = {(r.user_id, r.start, r.end, r.n, r.total, r.kinds) for r in arrive(spark, tmp_path, [(30.0, 2, "a", 1.0)], windows.sessions, **options)}
    assert found == {(1, at(1.0), at(2.5), 2, 2.0, "a,b"), (1, at(5.2), at(7.0), 2, 11.0, "a,c"), (None, at(6.0), at(7.0), 1, 1.0, "a")}


@pytest.mark.parametrize("windowed", [windows.sliding, windows.sessions])
def test_no_events(spark, windowed):
    assert windowed(spark.createDataFrame([], windows.EVENTS)).count() == 0


def test_partial_sums_are_made_before_the_shuffle(spark):
    plan = windows.sliding(spark.createDataFrame([], windows.EVENTS))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "partial_sum" in below and "Window" not in plan
