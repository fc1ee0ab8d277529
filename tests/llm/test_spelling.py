"""Spelling variants against plain loops: odd texts, long words, filters in many rounds and filters that are full."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling

COLUMNS = "doc_id long, text string, word string, n string, form string, root string, edit string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", "f", "r", "e") for i, t in rows], COLUMNS)


def is_near(a, b):
    """Whether one code point was inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows):
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if is_near(w, v))
        forms[w] = (near[0][1] if near and -near[0][0] >= 2 * n else None, len(near))
    out = []
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, forms[w][0], root, n, forms[w][1], words.get(forms[w][0])))
    return sorted(out, key=repr)


def result(docs):
    return sorted(map(tuple, spelling.spelling_forms(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeäß") for _ in range(rng.choice([5, 6, 7, 70]))) for _ in range(60)]

    def variant(w):
        k, c = rng.randrange(len(w)), rng.choice("abcdeäßÄ")
        return rng.choice([w, w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    chains = ["abcde"] * 40 + ["abcdf"] * 20 + ["abcgf"] * 10 + ["abhgf"] * 5 + ["zbhgf"] * 2
    texts = [" ".join(variant(rng.choice(words[: rng.choice([5, 60])])) for _ in range(150)) for _ in range(n)]
    odd = [(None, "nobody nobody nobody"), (500, None), (501, ""), (502, "Ⅷ ß× ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷"), (503, "tie-aa tieaa tieaa tieaa tieab tieab tieab tieac tieac tieac"), (504, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 30_000)]
    return [*enumerate(texts), *odd, (7, "repeat row words repeat row words"), (7, "repeat row words repeat row words"), *((600 + k, w) for k, w in enumerate(chains))]


@pytest.mark.parametrize("bounds", [{}, {"MOST_WORDS": 8, "SLICE": 64, "HELD": 20}, {"BITS": 1, "AT_ONCE": 16, "HELD_POINTS": 50}])
def test_equals_plain_loops(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(spelling, name, value)
    rows = corpus()
    want = brute(rows)
    assert result(table(spark, rows)) == want
    assert any(f for _, f, *_ in want) and any(r != f for _, f, r, *_ in want if f)


def test_empty_tables(spark):
    assert spelling.spelling_forms(table(spark, [])).count() == 0
    assert spelling.spelling_forms(table(spark, [(1, None), (2, "a b c")])).count() == 0


def test_edit_hashes_are_those_of_the_edited_words():
    word, out = "baabänna", set()
    full = np.full(4, 2**64 - 1, dtype=np.uint64)  # a filter that holds everything
    parts = {k: [spelling.Part(0, 1, 0, 4)] for k in range(20)}
    out = {e for e, w in spelling._edits([word], [ord(c) for c in "abnä"], parts, full)}
    deleted = {word[:k] + word[k + 1 :] for k in range(len(word))}
    replaced = {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "abnä" if c > word[k]}
    assert out == deleted | replaced


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.choice([6, 7]))) for _ in range(3000)})
    held, other = words[::2], words[1::2]
    rounds = spelling.rounds_of(Counter(map(len, held)))
    assert len(rounds) == 1
    filters = spelling._filters(spark.createDataFrame([(w,) for w in held], "word string"), rounds[0])

    def found(own):
        hits = 0
        for w in own:
            points = spelling._points([w])
            h = spelling._mixed((points * spelling._powers(len(w) - 1)).sum(1, dtype=np.uint64))
            mask = spelling._mask(h)
            hits += any((filters[p.slots(h)] & mask == mask).all() for p in rounds[0][len(w)])
        return hits

    assert found(held) == len(held) and found(other) < 0.02 * len(other)


def test_a_large_shard_is_cut_over_rounds(monkeypatch):
    monkeypatch.setattr(spelling, "MOST_WORDS", 100)
    rounds = spelling.rounds_of({5: 1000, 6: 50, 64: 10})
    assert all(sum(p.words for x in r.values() for p in x) <= 100 for r in rounds)
    h = spelling._mixed(np.arange(1000, dtype=np.uint64))
    taken = sum((p.slots(h) >= 0).astype(int) for r in rounds for p in r.get(5, []))
    assert (taken == 1).all()


def test_slices_never_cut_a_run(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 3)
    assert sum(spelling.runs_of("ab cdefgh ij,klmnop"), Counter()) == Counter(["ab", "cdefgh", "ij", "klmnop"])
