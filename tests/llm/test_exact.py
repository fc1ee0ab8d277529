"""Exact duplicates: odd rows, filters that fill up, groups met in a broadcast, against plain Python."""

import hashlib
from collections import Counter

import pytest

from tidemark.llm import exact

LOWER = str.maketrans(exact.UPPER, exact.LOWER)
TEXTS = [
    (1, "One text"), (2, None), (3, ""), (4, "ONE TEXT"), (5, "ÄRGER"), (6, "ärger"), (7, "x" * 500_000), (8, "X" * 500_000), (8, "X" * 500_000),
    (None, "one text"), (None, "no id"), (None, "NO id"), (9, "İ I"), (10, "İ i"), (11, "Σ"), (12, "only one"),
]
COLUMNS = "doc_id long, text string, n string, sha string, _block string, row string, _may string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "n", "s", "b", "r", "m") for i, t in rows], COLUMNS)


def brute(rows):
    """Sorted rows as the operator's contract has them."""
    texts = [(i, (t or "").translate(LOWER)) for i, t in rows]
    size, found, stays = Counter(t for _, t in texts), [], {}
    for at, (i, t) in enumerate(texts):
        if t not in stays or (-1 if i is None else i) > (-1 if stays[t][0] is None else stays[t][0]):
            stays[t] = (i, at)
    for at, (i, t) in enumerate(texts):
        found.append((i, stays[t][0], size[t], at == stays[t][1], hashlib.sha256(t.encode()).hexdigest()))
    return sorted(found, key=repr)


def result(docs):
    return sorted(map(tuple, exact.exact_duplicates(docs).collect()), key=repr)


def test_odd_rows(spark):
    assert result(table(spark, TEXTS)) == brute(TEXTS)
    assert exact.exact_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("bounds", [{"CELLS": 1, "MOST_BLOCKS": 1, "WORDS": 1}, {"LEAST_HOT": 2}, {"BITS": 1, "LEAST_HOT": 0, "HOT": 0.0}])
def test_full_filters_and_large_groups_lose_nothing(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(exact, name, value)
    rows = [(i, f"Text {i % 400 if i % 3 else 0}" if i % 7 else f"alone {i}") for i in range(3000)]
    assert result(table(spark, rows)) == brute(rows)


def test_rows_without_copies_are_marked_as_alone(spark):
    rows = exact._digests(table(spark, [(i, f"text {max(i, 100)}") for i in range(5000)]))
    cells = exact.possibly_repeated(rows, 5000)
    marked = exact.Repeats(exact.stage(cells, "cells"), 5000).marked(rows, "h")
    assert marked.where("doc_id <= 100 AND NOT _may").count() == 0
    assert marked.where("doc_id > 100 AND _may").count() < 0.05 * 4900


def test_dropping_keeps_every_column_and_one_row_a_text(spark):
    docs = table(spark, TEXTS)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted((i, t) for i, _, _, stays, t in brute(TEXTS) if stays and i is not None)
    got = [(r.doc_id, hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(x for x in got if x[0] is not None) == want and len(got) == len({t for _, t in got}) == len({x[4] for x in brute(TEXTS)})
    assert exact.drop_exact_duplicates(table(spark, [])).count() == 0


def test_plan_runs_no_python(spark):
    plan = exact.exact_duplicates(table(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "Window" not in plan
