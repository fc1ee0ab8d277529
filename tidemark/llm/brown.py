"""Brown class-based bigram language model, and its score of every text.

p(text) = product of p(class | class before) x p(word | class). Exchange clustering puts the most frequent
words into classes so that neighbouring classes tell most about each other; every other training word then
goes, in one exchange step, to the class that fits the classes on both its sides best. Counts of all words,
of class pairs and of contexts are summed over the whole training part; what grows with the vocabulary
stays in tables and is joined, and only tables with a set number of rows come to the driver or go to tasks.
Words that training has not seen are one further type in a class of its own. A word seen once would be
unseen had its text been left out, so its one occurrence counts half for its own class and half for that."""

from __future__ import annotations

from collections import Counter
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import in_batches, stage, tasks
from .tables import fold, read

#: Words that tasks look up by themselves, at most, each of at most LONGEST bytes; all others are joined.
FREQUENT, LONGEST = 131_072, 64
#: Words that the exchange algorithm clusters; words whose contexts are counted in tasks as one dense table; classes; passes.
CLUSTERED, COUNTED, CLASSES, PASSES = 1024, 16_384, 64, 8
#: Words that a task counts before it passes their counts on; pseudo-count of the class distribution.
HELD, MU = 300_000, 5.0
RARE, END = 0, 1  # ids; frequent words follow from 2 on
END_CLASS, REST_CLASS = CLASSES, CLASSES + 1
K = CLASSES + 2


def tokens(text: str | None) -> list[bytes]:
    """Words ([^\\x20\\x09-\\x0D]+) with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _word_counts(batches):
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for text in batch.column(0):
            seen.update(tokens(text.as_py()))
            if len(seen) > HELD:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _encoded(batches, ids: dict[bytes, int]):
    """(doc_id, held_out, text) to (doc_id, held_out, ids with the end, words that have none)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            flat, ends, rare = [], [0], []
            for text in part.column(2):
                words = tokens(text.as_py())
                own = list(map(ids.get, words, repeat(RARE)))
                rare.append([w for w, i in zip(words, own) if not i])
                flat += own
                flat.append(END)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            columns = [part.column(0), part.column(1), lists, pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "ids", "rare"])


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a batch's texts in a row, the id before each (END before the first of a text), and the texts' offsets."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)
    at = at - at[0]
    before = np.concatenate(([END], flat[:-1]))[: len(flat)]
    before[at[:-1]] = END
    return flat, before, at


def _pairs(batches, words: int):
    """Counts of neighbours among ids below `words`; all others count as RARE."""
    found = np.zeros(words * words, np.int64)
    for batch in batches:
        flat, before, _ = _flat(batch.column(0))
        flat, before = np.where(flat < words, flat, RARE), np.where(before < words, before, RARE)
        found += np.bincount(before * words + flat, minlength=words * words)
    yield from _rows(found)


def _rows(found: np.ndarray):
    keys = np.flatnonzero(found)
    for i in range(0, len(keys), 100_000):
        k = keys[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(found[k])], names=["k", "n"])


def _contexts(batches, classes: np.ndarray, lo: int, hi: int):
    """Counts of the classes before and after each id within lo and hi, by (id - lo) x 2K + side x K + class."""
    found = np.zeros((hi - lo) * 2 * K, np.int64)
    for batch in batches:
        flat, before, _ = _flat(batch.column(0))
        for word, other, side in ((flat, before, 0), (before, flat, 1)):
            at = (word >= lo) & (word < hi)
            found += np.bincount((word[at] - lo) * 2 * K + side * K + classes[other[at]], minlength=len(found))
    yield from _rows(found)


def _word_contexts(batches, names, classes: np.ndarray, lo: int):
    """(ids, rare) to (word, k, n): how often k = side x K + class is beside each word that is rare or has an id from `lo` on."""
    for batch in batches:
        flat, before, _ = _flat(batch.column(0))
        after = np.append(flat[1:], END)  # the last of a text is END, which no row is about
        at = np.flatnonzero((flat >= lo) | (flat == RARE))
        is_rare, ids = flat[at] == RARE, flat[at]
        words = batch.column(1).flatten()
        # rare words by their order, frequent ones by id, behind each other
        which = np.where(is_rare, np.cumsum(is_rare) - 1, len(words) + ids - lo)
        both = np.concatenate((which * (2 * K) + classes[before[at]], which * (2 * K) + K + classes[after[at]]))
        key, n = np.unique(both, return_counts=True)
        word = pa.concat_arrays([words, names]).take(pa.array(key // (2 * K)))
        for i in range(0, len(key), 50_000):
            cut = slice(i, i + 50_000)
            columns = [word[i : i + 50_000], pa.array((key[cut] % (2 * K)).astype(np.int32)), pa.array(n[cut])]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "k", "n"])


def _fitted(batches, table: np.ndarray):
    """(word, k, n), sorted by word, to (word, class): the class whose fit to all of a word's contexts is best."""
    held, fit = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column(0)
        cut = np.flatnonzero(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)) + 1
        begins = np.concatenate(([0], cut))
        sums = np.add.reduceat(table[batch.column(1).to_numpy()] * batch.column(2).to_numpy()[:, None], begins, axis=0)
        words = word.take(pa.array(begins))
        if held is not None and words[0].as_py() == held.as_py():
            sums[0] += fit
        elif held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.as_py()], pa.binary()), pa.array([fit.argmax()], pa.int32())], names=["word", "class"])
        held, fit = words[-1], sums[-1]
        if len(begins) > 1:
            best = pa.array(sums[:-1].argmax(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([words[:-1].cast(pa.binary()), best], names=["word", "class"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held.as_py()], pa.binary()), pa.array([fit.argmax()], pa.int32())], names=["word", "class"])


def _sequence(batch, at: int, classes: np.ndarray, number: np.ndarray):
    """Classes and training counts of a batch's tokens from columns ids, rare_class and rare_n; END before each text; offsets."""
    ids, before, ends = _flat(batch.column(at))
    cls, n = classes[ids], number[ids]
    cls[ids == RARE] = batch.column(at + 1).flatten().to_numpy()
    n[ids == RARE] = batch.column(at + 2).flatten().to_numpy()
    first = np.zeros(len(ids), bool)
    first[ends[:-1]] = True
    return cls, n, first, ends


def _before(values: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    return np.where(first, start, np.concatenate(([start], values[:-1]))[: len(values)])


def _transitions(batches, classes: np.ndarray, number: np.ndarray):
    """Counts of neighbouring classes times four: each token as it is and, if seen once, as unseen."""
    found = np.zeros(K * K, np.int64)
    for batch in batches:
        cls, n, first, _ = _sequence(batch, 0, classes, number)
        left_out = np.where((n == 1) & (cls != END_CLASS), REST_CLASS, cls)
        for a in (cls, left_out):
            for b in (cls, left_out):
                found += np.bincount(_before(a, first, END_CLASS) * K + b, minlength=K * K)
    yield from _rows(found)


def _grid(batches, classes: np.ndarray):
    """Counts of neighbouring classes where words without an id count as unseen."""
    found = np.zeros(K * K, np.int64)
    for batch in batches:
        flat, before, _ = _flat(batch.column(0))
        found += np.bincount(classes[before] * K + classes[flat], minlength=K * K)
    yield from _rows(found)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Counts by key; at most `size` rows come to the driver."""
    table = rows.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(size)
    found[table.column("k").to_numpy()] = table.column("n").to_numpy()
    return found


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, passes: int = PASSES, fixed: int = 0) -> np.ndarray:
    """Class of each word, by moving one word at a time to where the classes' mutual information is largest.

    pairs: counts of word after word; the first `fixed` words each stay alone in a class behind `classes`.
    Words start dealt out by rank; passes end when no word moves."""
    n, wide = len(pairs), classes + fixed
    of = np.concatenate((classes + np.arange(fixed), np.arange(n - fixed) % classes))
    one = np.eye(wide)[of]
    grid = one.T @ pairs @ one
    for _ in range(passes):
        moved = 0
        for w in range(fixed, n):
            row, col = np.bincount(of, pairs[w], wide), np.bincount(of, pairs[:, w], wide)
            own, self_ = of[w], pairs[w, w]
            row[own] -= self_
            col[own] -= self_
            grid[own] -= row
            grid[:, own] -= col
            grid[own, own] -= self_
            left, right = grid.sum(1), grid.sum(0)
            gain = (_xlogx(grid + row[None, :]) - _xlogx(grid)).sum(1) + (_xlogx(grid + col[:, None]) - _xlogx(grid)).sum(0)
            same = np.diag(grid)
            gain += _xlogx(same + row + col + self_) + _xlogx(same) - _xlogx(same + row) - _xlogx(same + col)
            out, into = row.sum() + self_, col.sum() + self_
            gain -= _xlogx(left + out) - _xlogx(left) + _xlogx(right + into) - _xlogx(right)
            best = int(gain[:classes].argmax()) if gain[:classes].max() > gain[own] + 1e-9 else own
            moved += best != own
            of[w] = best
            grid[best] += row
            grid[:, best] += col
            grid[best, best] += self_
        if not moved:
            break
    return of[fixed:]


def fit_table(grid: np.ndarray) -> np.ndarray:
    """Log-fit of each class (column) to a class before (first K rows) and after (last K) it, from counts of class pairs."""
    smooth = grid + 0.1
    before = np.log(smooth / smooth.sum(0))[:, :CLASSES]  # class before, class
    after = np.log(smooth / smooth.sum(1)[:, None])[:CLASSES].T  # class after, class
    return np.concatenate((before, after))


def _scored(batches, classes, number, log_next, size, log_total: float):
    """(doc_id, held_out, ids, rare_class, rare_n) to (doc_id, held_out, n_tokens, n_known, score, base_score)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cls, n, first, ends = _sequence(batch, 2, classes, number)
        total = lambda x: np.add.reduceat(x, ends[:-1])  # noqa: E731  no text is without its end
        logs = np.log10(n + 1)
        score = log_next[_before(cls, first, END_CLASS), cls] + np.where(cls < CLASSES, logs - np.log10(size)[cls], 0.0)
        columns = [pa.array(np.diff(ends).astype(np.int64)), pa.array(total((n > 0).astype(np.int64)))]
        columns += [pa.array(total(score)), pa.array(total(logs - log_total))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "score", "base_score"]
        )


def class_scores(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs.

    docs: doc_id, text and a boolean `held_out`; the model learns from the other rows. Scores are log10
    probabilities of a text's words and its end over the training words and one further type for all
    unseen ones; base_score is that of the add-one unigram model. Null texts count as empty: the end
    alone. Rows with a null `held_out` are scored, not learned from; repeated rows and null doc_ids stay;
    with nothing to learn from, every word is unseen and p is 1 for the one type there is. Words longer
    than LONGEST bytes are words like others, only never looked up in tasks."""
    held = F.coalesce(F.col(held_out), F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    train = rows.where(~F.col("held_out"))
    counted = in_batches(train.select("text"), _word_counts, "word binary, n long")
    counts = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    ends = train.count()
    size = counts.agg(F.count("n").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, v = size.n + ends, size.v + (ends > 0)

    # the lowest step of counts that keeps frequent words within FREQUENT
    step = F.floor(F.log2("n") * 32).cast("int")
    short = counts.where(F.length("word") <= LONGEST)
    least, room = 1 << 30, FREQUENT
    for s, words in sorted(short.groupBy(step.alias("s")).count().collect(), reverse=True):
        if words > room:
            break
        least, room = s, room - words
    is_frequent = (F.length("word") <= LONGEST) & (step >= least)
    table = counts.where(is_frequent).select("n", "word").toArrow()  # at most FREQUENT short words
    frequent = sorted(zip(*(c.to_pylist() for c in table.columns)), key=lambda r: (-r[0], r[1]))
    ids = {w: i + 2 for i, (_, w) in enumerate(frequent)}
    number = np.array([0, ends, *[c for c, _ in frequent]], np.int64)

    encoded = in_batches(rows, partial(_encoded, ids=ids), "doc_id long, held_out boolean, ids array<int>, rare array<binary>")
    encoded = stage(encoded.withColumn("uid", F.monotonically_increasing_id()), "encoded")
    learned = encoded.where(~F.col("held_out")).select("ids")

    top, dense = min(CLUSTERED + 2, len(number)), min(COUNTED + 2, len(number))
    classes = np.full(len(number), REST_CLASS)
    classes[END] = END_CLASS
    grid_of = lambda: _summed(learned.mapInArrow(partial(_grid, classes=classes), "k long, n long"), K * K).reshape(K, K)
    if top > 2:
        pairs = _summed(learned.mapInArrow(partial(_pairs, words=top), "k long, n long"), top * top).reshape(top, top)
        order = [END, RARE, *range(2, top)]  # END and all other words stay in classes of their own
        classes[2:top] = exchange(pairs[np.ix_(order, order)], CLASSES, fixed=2)
    if dense > top:
        found = learned.mapInArrow(partial(_contexts, classes=classes, lo=top, hi=dense), "k long, n long")
        contexts = _summed(found, (dense - top) * 2 * K).reshape(dense - top, 2 * K)
        classes[top:dense] = (contexts @ fit_table(grid_of())).argmax(axis=1)
    names = pa.array([w for _, w in frequent[dense - 2 :]], pa.binary())
    about = encoded.where(~F.col("held_out")).select("ids", "rare")
    beside = in_batches(about, partial(_word_contexts, names=names, classes=classes, lo=dense), "word binary, k int, n long")
    dealt = beside.repartition(tasks(docs.sparkSession), "word").sortWithinPartitions("word")
    fitted = stage(dealt.mapInArrow(partial(_fitted, table=fit_table(grid_of())), "word binary, class int"), "word-classes")
    fitted = stage(counts.join(fitted, "word").select("word", "n", "class", is_frequent.alias("is_frequent")), "classed-words")
    for word, c in fitted.where("is_frequent").select("word", "class").toArrow().to_pandas().itertuples(index=False):
        classes[ids[word]] = c
    rare = fitted.where("NOT is_frequent").select("word", F.col("class"), "n")

    # classes and counts of each text's rare words, in their order
    each = encoded.where(F.size("rare") > 0).select("uid", F.posexplode("rare").alias("pos", "word")).join(rare, "word", "left")
    token = F.struct("pos", F.coalesce("class", F.lit(REST_CLASS)).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))
    by_text = each.groupBy("uid").agg(F.array_sort(F.collect_list(token)).alias("rare"))
    texts = encoded.drop("rare").join(by_text, "uid", "left").select(
        "doc_id", "held_out", "ids", F.coalesce("rare.class", F.array().cast("array<int>")).alias("rare_class"),
        F.coalesce("rare.n", F.array().cast("array<bigint>")).alias("rare_n"))
    texts = stage(texts, "classed-texts")

    learned = texts.where(~F.col("held_out")).select("ids", "rare_class", "rare_n")
    found = learned.mapInArrow(partial(_transitions, classes=classes, number=number), "k long, n long")
    grid = _summed(found, K * K).reshape(K, K) / 4
    # words and tokens of each class
    tokens_in, types_in = np.bincount(classes[1:], number[1:], K), np.bincount(classes[1:], minlength=K).astype(float)
    once = np.bincount(classes[2:], number[2:] == 1, K)
    for r in rare.groupBy("class").agg(F.count("n").alias("v"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect():
        tokens_in[r["class"]] += r.n
        types_in[r["class"]] += r.v
        once[r["class"]] += r.once
    share = tokens_in - once / 2
    share[REST_CLASS], types_in[REST_CLASS] = once.sum() / 2, 1
    share = np.where(types_in > 0, share + 1, 0)
    share /= share.sum()
    log_next = np.log10(np.maximum((grid + MU * share) / (grid.sum(1, keepdims=True) + MU), 1e-300)) if ends else np.zeros((K, K))

    apply = partial(_scored, classes=classes, number=number, log_next=log_next, size=np.maximum(tokens_in + types_in, 1), log_total=np.log10(n + v + 1))
    scored = texts.mapInArrow(apply, "doc_id long, held_out boolean, n_tokens long, n_known long, score double, base_score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", perplexity
    )


def op7_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return class_scores(docs.select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out")))
