"""Spelling variants of a corpus's words: each word's neighbours at one edit, and the more frequent form it belongs to.

Words are counted in tasks and summed. Edits of a word are probed as hashes: a polynomial over code points gives the
hash of every deletion and replacement in one step each, without writing the edited word. They are probed against
blocked Bloom filters, one 64-bit block a probe, sharded by the length of the words they hold and sent to every task.
Only edits that a filter may hold are written out, shuffle, and meet the exact vocabulary, which removes the false
positives. A pair of words that differ by an insertion is found from the longer one's deletions, a pair that differs by
a replacement from the word with the lower code point; so each is found once.

A round's filters hold at most MOST_WORDS words of 64 bits. A larger vocabulary takes more rounds: shards are dealt
to rounds, and one that is too large alone is cut by hash, so what tasks are sent doesn't grow with the input."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import in_batches, release, stage, tasks
from .tables import read

#: Shortest word, its least count, and how many times a form must be as frequent as the word.
SHORTEST, LEAST, TIMES = 5, 3, 2
#: A run is damaged if its crc32 is divisible by this.
DAMAGED = 97
#: Words of LONG code points or more share a shard. Bits of a filter for each word; most words of 64 bits of a round's filters (32 MB).
LONG, BITS, MOST_WORDS = 64, 24, 1 << 22
#: Code points of a text that are counted at a time; words and code points that a task holds before it passes counts on.
SLICE, HELD, HELD_POINTS = 1 << 20, 300_000, 1 << 24
#: Edits of one kind that are hashed at a time.
AT_ONCE = 1 << 16

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Base of the polynomial, odd so that it has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def runs_of(text: str):
    """Counts of a text's runs of letters, a slice of the text at a time; a run is never cut."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        run = _RUN.match(text, end)
        end = run.end() if run else end
        yield Counter(_RUN.findall(text, at, end))
        at = end


def damaged(doc_id: int | None, run: str) -> str:
    """The run as it stands, or without one code point where its hash says so; a null id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8", "surrogatepass"))
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches):
    seen: Counter = Counter()
    points = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for runs in runs_of(text.as_py() or ""):
                for run, n in runs.items():
                    word = damaged(doc_id, run.lower() if run.isascii() else run.translate(_LOWER))
                    if len(word) >= SHORTEST:
                        points += len(word) * (word not in seen)
                        seen[word] += n
                if len(seen) > HELD or points > HELD_POINTS:
                    yield out()
                    seen.clear()
                    points = 0
    if seen:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of SHORTEST code points or more that occur LEAST times or more, staged."""
    counts = in_batches(docs.select("doc_id", "text"), _counted, "word string, n long")
    return stage(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "vocabulary")


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a hash spread over all 64 (a finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """Powers 0 to n of the base."""
    out = np.full(n + 1, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def _mask(h: np.ndarray) -> np.ndarray:
    """Five bits of a block, some of which may be the same."""
    out = np.zeros_like(h)
    for k in range(5):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _shard(length: int) -> int:
    return min(length, LONG)


class Part:
    """A filter's place in its round: part `k` of the `of` that its shard has, `words` words from `start` on."""

    def __init__(self, k: int, of: int, start: int, words: int):
        self.k, self.of, self.start, self.words = k, of, start, words

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The block of each mixed hash in the round's words, -1 for hashes of another part."""
        at = self.start + (((h >> np.uint64(32)) * np.uint64(self.words)) >> np.uint64(32)).astype(np.int64)
        return at if self.of == 1 else np.where(_mixed(h) % np.uint64(self.of) == np.uint64(self.k), at, -1)


def rounds_of(sizes: dict[int, int]) -> list[dict[int, list[Part]]]:
    """Rounds of {shard: parts} for shards with so many words, each of at most MOST_WORDS words of 64 bits."""
    out: list[dict[int, list[Part]]] = []
    used = MOST_WORDS
    for shard, n in sorted(sizes.items()):
        words = 1 + n * BITS // 64
        of = -(-words // MOST_WORDS)
        each = -(-words // of)
        for k in range(of):
            if used + each > MOST_WORDS:
                out.append(defaultdict(list))
                used = 0
            out[-1][shard].append(Part(k, of, used, each))
            used += each
    return [dict(x) for x in out]


def _by_length(batches):
    """(words) of one length, of as many as AT_ONCE code points allow."""
    for batch in batches:
        groups = defaultdict(list)
        for word in batch.column(0).to_pylist():
            groups[len(word)].append(word)
        for length, words in groups.items():
            step = max(1, AT_ONCE // length)
            for k in range(0, len(words), step):
                yield words[k : k + step]


def _filters(words: DataFrame, parts: dict[int, list[Part]]) -> np.ndarray:
    """The filters of a round: every word sets its bits in a block, summed by block in Spark."""

    def bits(batches):
        for own in _by_length(batches):
            found = parts.get(_shard(len(own[0])))
            if found:
                points = _points(own)
                h = _mixed((points * _powers(points.shape[1] - 1)).sum(1, dtype=np.uint64))
                for part in found:
                    at = part.slots(h)
                    here = at >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(at[here]), pa.array(_mask(h[here]).view(np.int64))], names=["slot", "mask"])

    rows = in_batches(words, bits, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(max((p.start + p.words for x in parts.values() for p in x), default=0), dtype=np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return out


def _hits(edits: np.ndarray, valid: np.ndarray, parts: list[Part], filters: np.ndarray):
    """Places (row, column) of valid edit hashes that a filter may hold."""
    rows, columns = np.nonzero(valid)
    h = _mixed(edits[rows, columns])
    for part in parts:
        at = part.slots(h)
        mask = _mask(h)
        held = (at >= 0) & ((filters[np.maximum(at, 0)] & mask) == mask)
        yield from zip(rows[held].tolist(), columns[held].tolist())


def _edits(words: list[str], alphabet: list[int], parts: dict[int, list[Part]], filters: np.ndarray):
    """(edit, word) of the deletions and replacements of words of one length that the round's filters may hold."""
    points = _points(words)
    length = points.shape[1]
    powers = _powers(length)
    terms = points * powers[:length]
    whole = terms.sum(1, dtype=np.uint64)[:, None]
    shorter, same = parts.get(_shard(length - 1), []), parts.get(_shard(length), [])
    if shorter and length > SHORTEST:
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        edits = before - terms + (whole - before) * np.uint64(_INVERSE)
        fresh = np.ones(points.shape, dtype=bool)  # one deletion of a run of equal letters
        fresh[:, 1:] = points[:, 1:] != points[:, :-1]
        for i, j in _hits(edits, fresh, shorter, filters):
            yield words[i][:j] + words[i][j + 1 :], words[i]
    for c in alphabet if same else []:
        edits = whole + (np.uint64(c) - points) * powers[:length]
        for i, j in _hits(edits, points < c, same, filters):
            yield words[i][:j] + chr(c) + words[i][j + 1 :], words[i]


def _candidates(words: DataFrame, alphabet: list[int], parts: dict[int, list[Part]], filters) -> DataFrame:
    """(edit, word) whose edit a filter of the round may hold; filters is a broadcast."""

    def probe(batches):
        edits, from_, points = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(edits, pa.string()), pa.array(from_, pa.string())], names=["edit", "word"])

        for own in _by_length(batches):
            for edit, word in _edits(own, alphabet, parts, filters.value):
                edits.append(edit)
                from_.append(word)
                points += 2 * len(word)
                if points > HELD_POINTS:
                    yield out()
                    edits, from_, points = [], [], 0
        if edits:
            yield out()

    return in_batches(words, probe, "edit string, word string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n, n) of a staged vocabulary (word, n): every pair that differs by exactly one inserted,
    deleted or replaced code point, both ways round."""
    spark = words.sparkSession
    sizes = dict(words.groupBy(F.least(F.length("word"), F.lit(LONG))).count().collect())  # LONG rows at most
    letters = words.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c != ''")
    alphabet = sorted(ord(r.c) for r in letters.collect())  # of the runs' letters, 90 at most
    dealt = words.select("word").repartition(4 * tasks(spark), "word")
    found = spark.createDataFrame([], "edit string, word string")
    for parts in rounds_of(sizes):
        filters = spark.sparkContext.broadcast(_filters(words.select("word"), parts))
        found = found.unionAll(_candidates(dealt, alphabet, parts, filters))
    edits = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = found.join(edits, "edit").join(words, "word")
    ends = [F.struct(F.col(a).alias("word"), F.col(m).alias("n"), F.col(b).alias("near"), F.col(k).alias("near_n")) for a, m, b, k in (("word", "n", "edit", "edit_n"), ("edit", "edit_n", "word", "n"))]
    return pairs.select(F.inline(F.array(*ends)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a staged table (word, form): forms followed to the last. Each step doubles how far a root has been
    followed, and counts at least double from form to form, so six or seven steps do."""
    current = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = stage(current.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not new.where("moved").count():
            return new.select("word", "root")
        current = new


def spelling_forms(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text).

    Words: runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, one in DAMAGED of them less one letter (`damaged`),
    of SHORTEST code points and LEAST occurrences or more. form is the near word of largest n, of equal ones the first in
    code-point order, if it occurs TIMES as often as the word, else null; root is where forms lead to, the word itself
    without one; n_near is 0 without near words. Null and empty texts have no words, texts of any length are read slice by
    slice, repeated rows count as often as they stand there, other columns are not read, an empty table has no rows."""
    words = vocabulary(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    found = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= TIMES * F.col("n")
    rows = stage(
        words.join(found, "word", "left").select(
            "word", F.when(often, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    release(words)
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(read(spark, sf_dir, "documents"))


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "xor(c >> 8, list_extract(t, (xor(c, b) & 255) + 1))"

OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
  runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWERED}') AS run FROM documents),
  seen AS (SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS x FROM runs GROUP BY ALL),
  hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: {_STEP}, 4294967295), 4294967295) AS h FROM seen, crc),
  cut AS (SELECT n, CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
  words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
  places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
  less AS (SELECT DISTINCT word, n, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS edit FROM places),
  holes AS (SELECT word, n, i, substr(word, 1, i::INT) || '_' || substr(word, i::INT + 2) AS edit FROM places),
  pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN words b ON a.edit = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.edit = b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM holes a JOIN holes b USING (i, edit) WHERE a.word <> b.word),
  best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
  forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form,
    CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
  ways AS (SELECT word, word AS root FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL),
  roots AS (SELECT w.word, w.root FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
