"""Joins by ids, ranges of ids and staged tables on nulls and empty tables."""

from pathlib import Path

import pytest

from tidemark.llm import staging
from tidemark.llm.ranges import bounds, bucket
from tidemark.sources.shared import scratch


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_by_ids_with_nulls_repeats_and_no_ids(spark, monkeypatch, most):
    monkeypatch.setattr(staging, "BROADCAST_IDS", most)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = staging.stage(spark.createDataFrame([(1,), (None,), (9,)], "doc_id long"), "ids")
    none = staging.stage(ids.limit(0), "none")
    got = lambda i, how: sorted(r.text for r in staging.by_ids(rows, i, how).collect())
    assert (got(ids, "left_semi"), got(ids, "left_anti")) == (["a", "b"], ["c", "d"])  # a null id equals none
    assert (got(none, "left_semi"), got(none, "left_anti")) == ([], ["a", "b", "c", "d"])
    assert staging.by_ids(rows.limit(0), ids, "left_anti").count() == 0


def test_ranges(spark):
    rows = spark.createDataFrame([(k,) for k in [None, *range(100), 5, 5, 5]], "doc_id long")
    cuts = bounds(rows, "doc_id", 8)
    found = rows.select("doc_id", bucket("doc_id", cuts).alias("b")).collect()
    assert 4 <= len(cuts) <= 7 and all(r.b == sum(c <= (-1 if r.doc_id is None else r.doc_id) for c in cuts) for r in found)
    assert bounds(rows.limit(0), "doc_id", 8) == [] and bounds(rows, "doc_id", 1) == []
    assert [r[0] for r in rows.limit(2).select(bucket("doc_id", [])).collect()] == [0, 0]


def test_staged_tables_are_released(spark):
    with scratch(spark):
        one, two = (staging.stage(spark.range(n), "some") for n in (3, 0))
        where = [Path(x.inputFiles()[0].removeprefix("file://")).parent for x in (one,)]
        staging.release(one, two)
        assert not where[0].exists()
        three = staging.stage(spark.range(2), "more")
        where.append(Path(three.inputFiles()[0].removeprefix("file://")).parent)
    assert not where[1].exists()
