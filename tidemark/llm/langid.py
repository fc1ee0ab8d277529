"""Language identification of mixed texts.

Letters' script ranges narrow the candidate languages of a word; a word's scores are log-likelihoods of
its character trigrams under each candidate; Viterbi with a switching penalty labels every word of a text,
and equal neighbours form spans. The language with most letters is the document's."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import in_batches, text_last, whole_rows
from .tables import fold, read

#: Bound of the documents that learning reads of each language, in expectation; of a language with fewer, all are read.
MAX_LEARNED = 1500
BUCKETS = 1 << 16
#: Log-likelihood that a change of language between two words costs.
SWITCH = 8.0
#: A word's advantage of one language over another counts up to this.
CLIP = 6.0
#: A script belongs to a language if it writes at least this share of the language's learned letters.
SCRIPT_SHARE = 0.01
#: Words times languages that a worker keeps scores of, padded words times languages that are labelled at a time,
#: and documents of an output batch.
CACHE, PADDED, ROWS = 800_000, 1 << 21, 500
#: Code points of a text beyond which it is labelled in pieces of words, times languages; trigrams times languages scored at a time.
LONG, SCORED = 1 << 22, 1 << 22
#: Words that learning keeps of a language before it counts their trigrams.
HELD = 200_000
MIN_SHARE = 0.5

#: First code points of blocks of letters and their script, from the Unicode block list.
SCRIPT_STARTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = [s for s, _ in SCRIPT_STARTS]
SCRIPTS = list(dict.fromkeys(name for _, name in SCRIPT_STARTS))


_SPACE = re.compile(r"\s")


def _pieces(text: str, size: int):
    """Words of a text, those of about `size` code points at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + size
        gap = _SPACE.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        if words:
            yield words
        at = end


def _script(letter: str) -> str:
    at = bisect_right(_STARTS, ord(letter)) - 1
    return SCRIPT_STARTS[at][1] if at >= 0 else "other"


def script_of(word: str) -> str:
    """Script of most letters, of several the one that comes first."""
    if word.isascii():
        return "latin" if word else "other"
    return Counter(map(_script, word)).most_common(1)[0][0]


def letters(word: str) -> str:
    """Letters (Unicode category L) of a word, in lower case: no digits, numerals, marks or symbols."""
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of `^word$`, one after another; which are whole; where each word begins."""
    marked = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    raw = np.frombuffer(b"".join(marked) + b"  ", np.uint8).astype(np.uint32)
    ends = np.cumsum([len(m) for m in marked])
    mixed = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    whole = np.ones(len(mixed), bool)
    whole[ends - 1] = whole[ends - 2] = False
    return (mixed >> np.uint32(16)).astype(np.int64) % BUCKETS, whole, np.concatenate(([0], ends[:-1]))


def _counts(batches):
    """(lang, text) to partial counts (lang, key, n): of trigram buckets by number, and of letters by script, as -1 - the
    number of the first block of that script."""
    words: dict[str, Counter] = {}
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def count(lang: str) -> None:
        seen = words[lang]
        own, n = list(map(letters, seen)), np.array(list(seen.values()))
        grams, scripts = counts.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)))
        for lo in range(0, len(own), HELD // 8):
            buckets, whole, starts = trigrams(own[lo : lo + HELD // 8])
            times = np.repeat(n[lo : lo + HELD // 8], np.diff(np.append(starts, len(buckets))))
            grams += np.bincount(buckets[whole], times[whole], minlength=BUCKETS).astype(np.int64)
        for word, k in zip(own, n.tolist()):
            if word:
                scripts[SCRIPTS.index(script_of(word))] += k * len(word)
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen = words.setdefault(lang, Counter())
            for piece in _pieces(text.as_py() or "", LONG // 8):
                seen.update(piece)
                if len(seen) > HELD:
                    count(lang)
    for lang, seen in words.items():
        if seen:
            count(lang)
    for lang, (grams, scripts) in counts.items():
        keys = np.concatenate((np.flatnonzero(grams), -1 - np.flatnonzero(scripts)))
        found = np.concatenate((grams[grams > 0], scripts[scripts > 0]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(found)], names=["lang", "key", "n"])


class Model:
    """Learned languages in order, log-likelihoods of trigram buckets by language, and languages of each script."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs, self.table, self.scripts = langs, table, scripts

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language (best 0, none below -CLIP, what their script rules out at -CLIP) and letters."""
        own = list(map(letters, words))
        sizes = np.array(list(map(len, own)))
        buckets, whole, starts = trigrams(own)
        sums = self._sums(buckets, whole, starts)
        rows = {s: i for i, s in enumerate(self.scripts)}
        fits = np.array([*self.scripts.values(), np.ones(len(self.langs), bool)])
        fits = fits[[rows.get(script_of(w), len(rows)) for w in own]]
        best = np.where(fits, sums, -np.inf).max(axis=1, keepdims=True)
        scores = np.where(fits, np.maximum(sums - best, -CLIP), -CLIP)
        scores[sizes == 0] = 0
        return scores, sizes

    def _sums(self, buckets: np.ndarray, whole: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each word's sum over its trigrams, of as many words at a time as SCORED allows; a longer word is summed in parts."""
        most, ends = max(1, SCORED // len(self.langs)), np.append(starts[1:], len(buckets))
        out = np.zeros((len(starts), len(self.langs)), self.table.dtype)
        word = 0
        while word < len(starts):
            last = max(word + 1, int(np.searchsorted(ends, starts[word] + most, "right")))
            lo, hi = int(starts[word]), int(ends[last - 1])
            if hi - lo <= most:
                out[word:last] = np.add.reduceat(np.where(whole[lo:hi, None], self.table[buckets[lo:hi]], 0), starts[word:last] - lo, axis=0)
            else:
                for at in range(lo, hi, most):
                    out[word] += np.where(whole[at : min(at + most, hi), None], self.table[buckets[at : min(at + most, hi)]], 0).sum(axis=0)
            word = last
        return out


def learn(docs: DataFrame, most: int = MAX_LEARNED) -> Model:
    """Model from (doc_id, text, lang). Null languages and texts are left out; without rows it knows no language.

    Of a language with more than `most` rows, those whose hash is lowest are read, about `most` of them, so
    that rare languages and small sources are learned too. What comes to the driver is bounded by BUCKETS
    times languages, and so is the model: 256 KB a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = known.groupBy("lang").count().select(F.col("lang").alias("_lang"), (F.lit(float(most)) / F.col("count")).alias("_share"))
    drawn = F.xxhash64("doc_id", F.lit("language sample")) < -(2.0**63) + 2.0**64 * F.col("_share")
    known = known.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where((F.col("_share") >= 1) | drawn)
    partials = in_batches(known.select("lang", "text"), _counts, "lang string, key long, n long")
    rows = partials.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    langs, at = np.unique(np.array(rows.column("lang").to_pylist(), object), return_inverse=True)
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    grams = np.full((BUCKETS, len(langs)), 0.5)
    written = np.zeros((len(SCRIPTS), len(langs)))
    grams[key[key >= 0], at[key >= 0]] += n[key >= 0]
    written[-1 - key[key < 0], at[key < 0]] += n[key < 0]
    table = np.log(grams / grams.sum(axis=0)) if len(langs) else grams
    fits = (written > 0) & (written >= SCRIPT_SHARE * written.sum(axis=0))
    return Model(langs.tolist(), table.astype(np.float32), {s: f for s, f in zip(SCRIPTS, fits) if f.any()})


class _Words(dict):
    """Number of each word's row of scores and letters; new words are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.clear()

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return self[word]

    def clear(self) -> None:
        super().clear()
        self.scores, self.sizes = np.empty((0, len(self.model.langs))), np.empty(0, np.int64)
        self.new.clear()

    def score(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            scores, sizes = self.model.words(self.new)
            self.scores, self.sizes = np.concatenate((self.scores, scores)), np.concatenate((self.sizes, sizes))
            self.new.clear()
        return self.scores, self.sizes


def viterbi(emission: np.ndarray, lengths: np.ndarray, words: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best languages of each text's words. words: row numbers in emission, [longest, texts], texts by falling length."""
    longest, n = words.shape
    best = emission[words[0]].copy()
    came = np.zeros((longest, n, emission.shape[1]), np.int16)
    active = (lengths[None, :] > np.arange(longest)[:, None]).sum(axis=1)
    stay = np.arange(emission.shape[1], dtype=np.int16)
    for t in range(1, longest):
        k = active[t]
        b = best[:k]
        top = b.argmax(axis=1)
        moved = b[np.arange(k), top] - penalty
        keeps = b >= moved[:, None]
        came[t, :k] = np.where(keeps, stay, top[:, None])
        best[:k] = np.where(keeps, b, moved[:, None]) + emission[words[t, :k]]
    state, out = best.argmax(axis=1), np.empty((longest, n), np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        out[t, :k] = state[:k]
        if t:
            state[:k] = came[t, np.arange(k), state[:k]]
    return [out[: lengths[d], d] for d in range(n)]


def _steps(emission: np.ndarray, best: np.ndarray | None, penalty: float, came: np.ndarray | None) -> np.ndarray:
    """Values of the languages after a piece's words, from those before it (None: the text begins), as `viterbi` has them.

    came: gets the language that each language at a word comes from."""
    stay = np.arange(emission.shape[1])
    for t, e in enumerate(emission):
        if best is None:
            best = e.copy()
            continue
        top = best.argmax()
        moved = best[top] - penalty
        keeps = best >= moved
        if came is not None:
            came[t] = np.where(keeps, stay, top)
        best = np.where(keeps, best, moved) + e
    return best


def label_long(text: str, model: Model, penalty: float) -> tuple[str, float, tuple]:
    """Label of a text of any length, in memory of a piece: forwards only the values before each piece are kept, and backwards
    each piece is walked again from them."""
    size = max(1, LONG // 8 // len(model.langs))

    def emissions():
        for words in _pieces(text, size):
            known = {w: k for k, w in enumerate(dict.fromkeys(words))}
            scores, sizes = model.words(list(known))
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            yield scores[at], sizes[at]

    best, before = None, []
    for emission, _ in emissions():
        before.append(best)
        best = _steps(emission, best, penalty, None)
    if best is None:
        return "und", 0.0, _NO_SPANS
    state, by, ends = int(best.argmax()), np.zeros(len(model.langs)), len(before)
    found: list[tuple[np.ndarray, int]] = []
    for k, words in zip(range(ends - 1, -1, -1), _backwards(text, size)):
        known = {w: i for i, w in enumerate(dict.fromkeys(words))}
        scores, sizes = model.words(list(known))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        came = np.zeros((len(words), len(model.langs)), np.int16)
        _steps(scores[at], before[k], penalty, came)
        labels = np.empty(len(words), np.int16)
        for t in range(len(words) - 1, -1, -1):
            labels[t] = state
            if t or k:
                state = int(came[t, state])
        by += np.bincount(labels, sizes[at], minlength=len(model.langs))
        cut = np.flatnonzero(np.diff(labels)) + 1
        starts = np.concatenate(([0], cut))
        found.append((np.stack((labels[starts].astype(np.int64), starts)), len(words)))
    if not by.sum():
        return "und", 0.0, _NO_SPANS
    first, spans = 0, []
    for cut, n in reversed(found):
        spans.append(cut + np.array([[0], [first]]))
        first += n
    langs, starts = np.concatenate(spans, axis=1)
    new = np.concatenate(([True], langs[1:] != langs[:-1]))  # a span may go on over pieces
    langs, starts = langs[new], starts[new]
    return model.langs[int(by.argmax())], float(by.max() / by.sum()), (langs, starts, np.diff(np.append(starts, first)))


def _backwards(text: str, size: int):
    """The pieces of a text, the last first; places of their ends are kept, not their words."""
    cuts, at = [], 0
    while at < len(text):
        gap = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        cuts.append((at, end))
        at = end
    for a, b in reversed(cuts):
        words = text[a:b].split()
        if words:
            yield words


_NO_SPANS = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))


def _labelled(batches, model: Model, penalty: float):
    """Batches whose last column is the text: the other columns, lang_pred, score and spans."""
    words = _Words(model)

    def label(texts: list[list[int]], done: list) -> None:
        scores, sizes = words.score()
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        lo = 0
        while lo < len(order):
            hi = max(lo + 1, min(len(order), lo + PADDED // len(model.langs) // len(texts[order[lo]])))
            part = order[lo:hi]
            lengths = np.array([len(texts[i]) for i in part])
            padded = np.zeros((lengths[0], len(part)), np.int64)
            for d, i in enumerate(part):
                padded[: lengths[d], d] = texts[i]
            for d, (i, labels) in enumerate(zip(part, viterbi(scores, lengths, padded, penalty))):
                by = np.bincount(labels, sizes[padded[: lengths[d], d]], minlength=len(model.langs))
                if by.sum():
                    starts = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1))
                    done[i] = (model.langs[by.argmax()], by.max() / by.sum(), (labels[starts].astype(np.int64), starts, np.diff(np.append(starts, lengths[d]))))
            lo = hi

    for batch in batches:
        last = batch.num_columns - 1
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            if len(words) * len(model.langs) > CACHE:
                words.clear()
            done: list = [("und", 0.0, _NO_SPANS)] * rows.num_rows
            texts: list[list[int]] = [[]] * rows.num_rows
            for i, t in enumerate(rows.column(last) if model.langs else []):
                text = t.as_py() or ""
                if len(text) * len(model.langs) > LONG:
                    done[i] = label_long(text, model, penalty)
                else:
                    texts[i] = list(map(words.__getitem__, text.split()))
            label(texts, done)
            pred, score, spans = zip(*done)
            names = pa.array(model.langs or ["und"], pa.string())
            lang, first, count = (np.concatenate([x[k] for x in spans]) for k in range(3))
            flat = pa.StructArray.from_arrays([names.take(pa.array(lang)), pa.array(first), pa.array(count)], names=["lang", "first_word", "words"])
            ends = np.cumsum([0, *(len(x[0]) for x in spans)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:last], pa.array(pred), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                names=[*rows.schema.names[:last], "lang_pred", "score", "spans"],
            )


def _labelled_rows(batches, model: Model, penalty: float):
    return _labelled(text_last(batches), model, penalty)


def _with_labels(schema: T.StructType) -> T.StructType:
    span = T.StructType().add("lang", "string").add("first_word", "long").add("words", "long")
    return T.StructType([*schema]).add("lang_pred", "string").add("score", "double").add("spans", T.ArrayType(span))


def identify(docs: DataFrame, model: Model, keep: list[str], penalty: float = SWITCH) -> DataFrame:
    """Columns `keep`, lang_pred, score and spans of every whole text.

    spans: language, first word and number of words (split at white space) of each run. score: the share
    of letters in spans of lang_pred. Ties go to the language first in the alphabet. Null texts and texts
    without a letter, and all texts if no language was learned: `und`, score 0, no spans."""
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))
    schema = _with_labels(T.StructType([rows.schema[c] for c in keep]))
    return in_batches(rows, partial(_labelled, model=model, penalty=penalty), schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def language_filter(docs: DataFrame, least: float = MIN_SHARE) -> DataFrame:
    """Rows of `docs`, as they were, with a known language that at least `least` of the letters are in."""
    model = learn(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    rows = whole_rows(docs)
    found = in_batches(rows, partial(_labelled_rows, model=model, penalty=SWITCH), _with_labels(rows.schema))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
