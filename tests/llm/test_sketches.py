"""Sketches of shingle sets: no alike pair is ruled out at any two widths, and unrelated long texts are."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import simhash_kernel as kernel


def sketches(sets):
    odd = [np.bincount((s % np.uint64(kernel.sketch_bits(len(s)))).astype(np.int64), minlength=kernel.sketch_bits(len(s))) & 1 for s in sets]
    return [np.packbits(x.astype(np.uint8)).tobytes() for x in odd]


def crossed(sets, block=None, nearest=False):
    n = len(sets)
    block = block or [0] * n
    table = pa.table({"lo": [0] * n, "hi": [max(block)] * n, "block": block, "id": list(range(n)), "component": list(range(n)), "size": pa.array([len(s) for s in sets], pa.int32()), "sketch": sketches(sets)})
    found = kernel.crossing(table, 0.8, nearest)
    return {tuple(sorted(p)) for p in zip(found.column("a").to_pylist(), found.column("b").to_pylist())}


@pytest.mark.parametrize("size", [40, 1800, 2040, 4090, 9000])
def test_alike_sets_of_neighbouring_widths_meet(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, size + size // 4).astype(np.uint64)
    sets = [base[:size], base[: size + size // 9], base[size // 10 :], base[size // 5 : size + size // 5]]
    alike = {(i, j) for i in range(4) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8}
    want = {tuple(sorted(p)) for p in alike}
    assert want and want <= crossed(sets) and want <= crossed([*sets], [0, 1, 0, 1]) | {p for p in want if (p[0] + p[1]) % 2 == 0}


@pytest.mark.parametrize("size", [500, 4000, 6000, 30_000])
def test_unrelated_sets_are_ruled_out(size):
    rng = np.random.default_rng(size)
    header = rng.integers(0, 2**63, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate((header, rng.integers(0, 2**63, size + k * 7).astype(np.uint64)))) for k in range(20)]
    assert not crossed(sets)
