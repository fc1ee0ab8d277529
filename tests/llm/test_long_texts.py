"""Very long texts: language labels in pieces equal those of the whole, in the memory of a piece; training holds no rows."""

import random
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import langid, quality


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    table = np.log(rng.random((langid.BUCKETS, 3)) + 0.01).astype(np.float32)
    return langid.Model(["de", "en", "ru"], table, {"latin": np.array([True, True, False]), "cyrillic": np.array([False, False, True])})


def texts(n=40, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(rng.choice(["abcdefgh", "abcdefgh", "абвгд", "12"])) for _ in range(rng.randrange(1, 9)))
    odd = ["", " 　\n", "7", "7 8 9", "a" * 5000, "a" * 5000 + " " + "b" * 3000, " a ", "a b\x1cc"]
    return odd + [rng.choice([" ", "\n", "  "]).join(word() for _ in range(rng.randrange(1, 300))) for _ in range(n)]


@pytest.mark.parametrize("long, scored", [(8, 1 << 22), (400, 30), (3000, 7)])
def test_pieces_are_labelled_as_the_whole(spark, model, monkeypatch, long, scored):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def found():
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
        return [r for b in langid._labelled([batch], model, langid.SWITCH) for r in b.to_pylist()]

    whole = found()
    monkeypatch.setattr(langid, "LONG", long)
    monkeypatch.setattr(langid, "SCORED", scored)
    for a, b in zip(whole, found(), strict=True):
        assert a["lang_pred"] == b["lang_pred"] and a["spans"] == b["spans"] and a["score"] == pytest.approx(b["score"])
    assert docs.count() == len(rows)


def test_memory_is_that_of_a_piece(model):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(200_000))
    langid.label_long(text[:1000], model, 8.0)
    tracemalloc.start()
    lang, _, spans = langid.label_long(text, model, 8.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lang in model.langs and spans[2].sum() == 200_000 and peak < 60 << 20  # all scores and steps at once are 200 MB


def test_learning_counts_in_parts(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["de", "en", "de"]), pa.array(texts(3))[-3:]], names=["lang", "text"])
    rows = lambda: sorted((r["lang"], r["key"], r["n"]) for b in langid._counts([batch]) for r in b.to_pylist())
    want = rows()
    monkeypatch.setattr(langid, "HELD", 8)
    monkeypatch.setattr(langid, "LONG", 80)
    assert rows() == want != []


def test_training_keeps_no_rows():
    import pyarrow as pa

    rng = np.random.default_rng(4)

    def batches():
        for k in range(60):  # 60 texts of 2^17 n-grams, 94 MB
            index = rng.choice(1 << quality.BITS, 1 << 17, replace=False).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([k % 2]), pa.array([index.tobytes()]), pa.array([np.full(1 << 17, 1e-4).tobytes()])], names=["label", "index", "weight"])

    tracemalloc.start()
    (out,) = quality._train(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out.column(0)[0].as_py()) == 4 * (1 + (1 << quality.BITS)) and peak < 40 << 20
