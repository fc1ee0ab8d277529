"""Vector codes: the two trees against plain loops over integers, odd vectors, ties and copies."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import codebooks

COLUMNS = "vec_id long, embedding array<double>, label int, x string, n string, trees string, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "n", "t", "c") for i, v, k in rows], COLUMNS)


def brute(rows, length, rounds=6):
    """{(vec_id, code, error, label_error)} and the books' digest, for vectors of one length, by loops over Python's integers."""
    kept = [(i, [math.floor(4096 * c) for c in v], k) for i, v, k in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [length // 8 + (k < length % 8) for k in range(8)]
    cuts = [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(8)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][a:b] for r in order[:16]] for a, b in cuts]

    def nearest(part, v):
        return min((sum((p - q) ** 2 for p, q in zip(v, e)), k) for k, e in enumerate(books[part]))

    for _ in range(rounds):
        for part, (a, b) in enumerate(cuts):
            sums = defaultdict(list)
            for _, v, _ in kept:
                sums[nearest(part, v[a:b])[1]].append(v[a:b])
            for k, own in sums.items():
                books[part][k] = [sum(c) // len(own) for c in zip(*own)]
    coded = []
    for i, v, k in kept:
        best = [nearest(part, v[a:b]) for part, (a, b) in enumerate(cuts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), k))
    by_label = defaultdict(int)
    for _, _, error, k in coded:
        by_label[k] += error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[k]) for i, c, e, k in coded), key=repr), digest


def result(docs):
    rows = codebooks.vector_codes(docs).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=repr), {r.codebooks_sha256 for r in rows}


def vectors(n, length, seed=3, spread=0.02):
    rng = random.Random(seed)
    heads = [[rng.uniform(-1, 1) for _ in range(length)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(heads)], rng.choice([None, 1, 2])) for i in range(n)]


ODD = [(1000, None, 1), (1001, [1.0, None] * 8, 1), (1002, [float("nan")] * 16, 2), (1003, [float("-inf")] * 16, None), (None, [0.5] * 16, 9)]


@pytest.mark.parametrize("leaf, rows", [(24, 8192), (1, 64), (3, 100)])
def test_equals_plain_loops(spark, monkeypatch, leaf, rows):
    monkeypatch.setattr(codebooks, "LEAF", leaf)
    monkeypatch.setattr(codebooks, "MOST_ROWS", rows)
    data = [*vectors(300, 16), *ODD, (5, [0.25] * 16, 1), (5, [0.25] * 16, 1)]
    want, digest = brute(data, 16)
    assert result(table(spark, data)) == (want, {digest})


def test_ties_copies_and_equal_entries(spark):
    rng = random.Random(1)
    data = [(i, [rng.choice([0.0, 1.0]) for _ in range(8)], i % 2) for i in range(120)] + [(i, [0.0] * 8, None) for i in range(200, 400)]
    want, digest = brute(data, 8)
    assert result(table(spark, data)) == (want, {digest})


def test_few_vectors_and_uneven_parts(spark):
    data = vectors(5, 11)
    want, digest = brute(data, 11)
    assert result(table(spark, data)) == (want, {digest})
    assert codebooks.vector_codes(table(spark, [])).count() == 0
    assert codebooks.vector_codes(table(spark, [(1, None, 1)])).count() == 0


def test_other_lengths_and_huge_components_have_no_code(spark):
    data = vectors(40, 8)
    want, digest = brute(data, 8)
    got, digests = result(table(spark, [*data, (90, [1.0] * 9, 7), (91, [1e300] * 8, 7), (92, [], 8)]))
    assert digests == {digest} and [r for r in got if r[1]] == want
    assert [r for r in got if not r[1]] == [(90, None, None, None), (91, None, None, None), (92, None, None, None)]


def test_whole_nodes_take_most_points():
    rng = np.random.default_rng(5)
    points = (rng.integers(0, 8, (8000, 1)) * 4000 + rng.integers(-50, 50, (8000, 8))).astype(np.int64)
    tree = codebooks.PointTree.built(points)
    again = codebooks.PointTree.unpacked(tree.packed(), 8000, 8)
    book = np.repeat(np.arange(8) * 4000, 2)[:, None] + np.zeros((1, 8), dtype=np.int64)
    whole = sum(got[2] - got[1] for got in codebooks.assigned(again, book) if len(got) == 4)
    assert whole > 0.9 * 8000
    brute_best = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    best = np.empty(8000, dtype=np.int64)
    for got in codebooks.assigned(again, book):
        best[slice(*got[1:3]) if len(got) == 4 else got[1]] = got[0]
    assert (best == brute_best[again.order]).all()
