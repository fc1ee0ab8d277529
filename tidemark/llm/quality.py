"""Quality classifier: hashed word n-gram logistic regression by follow-the-regularised-leader updates.

A text gives four families of n-grams: single words and pairs of neighbours, as written and as shapes
(letter case, digits and punctuation kept, lengths dropped). Each is hashed into one of 2^BITS weights and
weighs its share of its family. Training visits a bounded, hash-chosen set of labelled documents one at a
time; scoring is a gather and a sum over the weights, map-side over whole texts."""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import in_batches, release, stage, tasks, text_last, whole_rows
from .tables import fold, read

BITS = 18
#: Bound of the labelled documents that training reads, in expectation; all are read where there are fewer.
MAX_LABELLED = 6000
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 3, 0.3, 1.0, 0.002, 0.01, 30.0
THRESHOLD = 0.3

_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"([Aa0])\1+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are taken apart at a time.
PART = 1 << 20


def _hashed(words: list[bytes], salt: int, before: int | None) -> tuple[list[np.ndarray], int]:
    """Weight numbers of the words and of pairs of neighbours, and the last word's hash; `before` is the one before the first."""
    one = np.array(list(map(zlib.crc32, words)), dtype=np.uint64)
    single = (one * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(64 - BITS)
    row = one if before is None else np.concatenate((np.array([before], np.uint64), one))
    both = row[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + row[1:] * np.uint64(0x165667B19E3779F9) + np.uint64(salt)
    both = (both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    both[row[:-1] == row[1:]] = salt >> 60  # a word said twice is one and the same pair, whatever the word
    return [single.astype(np.int64), both.astype(np.int64)], int(one[-1])


def _parts(raw: bytes):
    """A text in parts of about PART bytes that end where a word does."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        if end < len(raw) and (gap := _SPACE.search(raw, end)):
            end = gap.start()
        elif end < len(raw):
            end = len(raw)
        yield raw[at:end]
        at = end


def features(text: str | None):
    """Weight numbers of a text's n-grams part by part, one array a family; nothing for null and blank texts."""
    words_end = shapes_end = None
    for part in _parts((text or "").encode("utf-8", "surrogatepass")):
        words = part.split()
        if words:
            shapes = _RUN.sub(rb"\1", part.translate(_SHAPE)).split()
            own, words_end = _hashed(words, 0, words_end)
            alike, shapes_end = _hashed(shapes, 1 << 60, shapes_end)
            yield [*own, *alike]


def _sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of a text and what each weighs: SCALE a family, shared out over its n-grams."""
    found = [[np.unique(f, return_counts=True) for f in block] for block in features(text)]
    index, weight = [], []
    for family in zip(*found):
        total = sum(int(n.sum()) for _, n in family)
        for i, n in family:
            index.append(i), weight.append(n * (SCALE / max(total, 1)))
    if not index:
        return np.empty(0, np.int32), np.empty(0)
    index, at = np.unique(np.concatenate(index), return_inverse=True)
    return index.astype(np.int32), np.bincount(at, np.concatenate(weight))


def _taken_apart(batches):
    """(order, tie, label, text) to the same with a text's weight numbers and weights, as bytes, in its place."""
    for batch in (b for b in batches if b.num_rows):
        parts = [_sparse(text.as_py()) for text in batch.column(3)]
        index, weight = (pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*parts), ("<i4", "<f8")))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], index, weight], names=["order", "tie", "label", "index", "weight"])


def _train(batches):
    """All rows (label, index, weight) of the one partition, every epoch's in order, to one row of weights: the bias and 2^BITS
    others. Rows are read once and let go; what is kept is three numbers for each weight."""
    size = 1 + (1 << BITS)
    z, n = np.zeros(size), np.zeros(size)
    for batch in batches:
        for label, index, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            i = np.concatenate(([0], np.frombuffer(index.as_py(), "<i4") + 1))
            x = np.concatenate(([1.0], np.frombuffer(value.as_py(), "<f8")))
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - float(label)) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()])], names=["weights"])


def train(labelled: DataFrame, most: int = MAX_LABELLED) -> bytes:
    """Weights from (doc_id, text, label). Rows with a null label are left out; without rows all weights are 0.

    Where there are more than `most` rows, those whose hash is lowest are taken, about `most` of them:
    the one task that runs the updates reads that bounded sample, whatever the input. Texts are taken apart in many tasks
    and staged, 12 bytes for each distinct n-gram, of which hashing leaves 2^BITS at most. The one task is sent them in
    order, epoch after epoch, by a sort that spills, so it holds a batch of rows and the weights, however long texts are."""
    known = labelled.where(F.col("label").isNotNull())
    total = known.count()
    order = F.xxhash64("doc_id", F.lit("quality sample"))
    if total > most:
        known = known.where(order < F.lit(int(-(2**63) + 2**64 * (most / total))))
    rows = known.select(order.alias("order"), F.xxhash64("text").alias("tie"), F.col("label").cast("int").alias("label"), "text")
    taken = "order long, tie long, label int, index binary, weight binary"
    apart = stage(in_batches(rows.repartition(tasks(labelled.sparkSession), "order", "tie"), _taken_apart, taken), "quality-rows")
    epochs = apart.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).repartition(1)
    found = in_batches(epochs.sortWithinPartitions("epoch", "order", "tie", "label").select("label", "index", "weight"), _train, "weights binary").first()
    release(apart)
    return bytes(found[0]) if found else np.zeros(1 + (1 << BITS), "<f4").tobytes()


def _scored(batches, weights: bytes):
    w = np.frombuffer(weights, dtype="<f4").astype(np.float64)
    bias, w = w[0], w[1:]
    for batch in batches:
        scores = []
        for text in batch.column(batch.num_columns - 1):
            sums, sizes = np.zeros(4), np.zeros(4)
            for block in features(text.as_py()):
                sums += [w[f].sum() for f in block]
                sizes += [len(f) for f in block]
            z = bias + SCALE * (sums / np.maximum(sizes, 1)).sum()
            scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def _scored_rows(batches, weights: bytes):
    return _scored(text_last(batches), weights)


def score(docs: DataFrame, weights: bytes, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` and `score`, the probability of label 1, of every whole text. Null and empty: the bias's."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    return in_batches(rows, partial(_scored, weights=weights), schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside fold 0 of 5; a doc_id with two labels counts with each."""
    known = labels.where(F.col("quality").isNotNull() & (fold("doc_id", 5) != 0))
    return docs.select("doc_id", "text").join(known.select("doc_id", F.col("quality").alias("label")), "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = train(training_rows(docs, read(spark, sf_dir, "labels")))
    scored = score(docs, weights, ["doc_id"])
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` whose text scores at least `threshold`, with their columns as they were.

    The texts are scored where they are read, so no row is joined or shuffled: null and empty texts pass
    if the bias alone does."""
    weights = train(training_rows(docs, labels))
    rows = whole_rows(docs)
    schema = T.StructType([*rows.schema, T.StructField("score", T.DoubleType())])
    scored = in_batches(rows, partial(_scored_rows, weights=weights), schema)
    return scored.where(F.col("score") >= threshold).select("row.*")
