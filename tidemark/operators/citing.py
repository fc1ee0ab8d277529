"""Citations and mentions: ids of records in texts to footnotes, and texts that mention any of very many aliases."""

from __future__ import annotations

import sys
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import staged

#: Texts of one set that one task links at a time.
AT_ONCE = 20_000
#: Code points of an alias that are looked up, and of a piece of a text at least, where pieces shuffle and where they don't.
GRAM, PIECE, SHORT = 3, 64, 16
#: Aliases whose keys are sent to every task at most; beyond that the join shuffles.
FEW = 200_000
#: Code points of a key that is sent to tasks, the most that its alias has; those that an alias's key is taken from.
SIZES, HEAD = (1, 2, 3, 4, 6, 8), 16
#: Code points that a task looks through at a time, and bits of the table that it looks hashes up in first.
AT_A_TIME, TABLE = 1 << 18, 22

_END = ""


def trie_of(ids) -> dict:
    """Ids as nested dictionaries by code point; an id's end holds the id."""
    root: dict = {}
    for found in ids:
        node = root
        for c in found:
            node = node.setdefault(c, {})
        node[_END] = found
    return root


def ids_at(trie: dict, text: str, at: int) -> list[str]:
    """Ids that a text has at a place, the shortest first."""
    found, node = [], trie
    for k in range(at, len(text)):
        node = node.get(text[k])
        if node is None:
            break
        if _END in node:
            found.append(node[_END])
    return found


def _leading(trie: dict, text: str) -> tuple[str | None, int]:
    """The longest id that a text begins with, alone or in brackets, before a colon, and where the rest begins."""
    start = int(text.startswith("["))
    for found in reversed(ids_at(trie, text, start)):
        at = start + len(found)
        at += text[at : at + 1] == "]"
        while text[at : at + 1].isspace():
            at += 1
        if text[at : at + 1] in (":", "：") and at < len(text):
            return found, len(text) - len(text[at + 1 :].lstrip())
    return None, 0


def linked(trie: dict, numbers: dict[str, int], text: str, marker: str) -> str:
    """A text with each id that it has, and the brackets around it, as a footnote marker; a leading `ID:` comes last."""
    text = text.strip()
    first, at = _leading(trie, text)
    out = []
    while at < len(text):
        start = at + (text[at] == "[")
        found = ids_at(trie, text, start) or (ids_at(trie, text, at) if start > at else [])
        if found:
            start = start if text[start : start + len(found[-1])] == found[-1] else at
            at = start + len(found[-1])
            at += text[at : at + 1] == "]"
            out.append(marker.format(numbers[found[-1]]))
        else:
            out.append(text[at])
            at += 1
    if first is not None:
        out.append(marker.format(numbers[first]))
    return "".join(out)


def linkify(texts: DataFrame, records: DataFrame, key: str, text: str, marker: str = "[^{}]") -> DataFrame:
    """`texts` (key, text and any other columns) with `linked`: ids of the key's records as footnotes, by the longest that fits.

    records: (key, evidence_id, number); an id that occurs twice has its smallest number, null and empty ids are left out.
    The ids of one key are a trie in a task; texts of a key with more than AT_ONCE are dealt to several tasks, each of
    which gets the ids. A null text is empty; a key without records keeps its texts but for white space at their ends."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = staged(texts.select(F.struct("*").alias("row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "texts")
    deals = staged(rows.groupBy(F.col("_key").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / AT_ONCE).cast("int").alias("_deals")), "deals")
    deals = F.broadcast(deals) if deals.count() <= FEW else deals
    ids = records.where(F.col("evidence_id") != "").groupBy(F.col(key).alias("_key"), "evidence_id").agg(F.min("number").cast("long").alias("number"))
    known = ids.join(deals, F.col("_key").eqNullSafe(F.col("_of")))
    known = known.select("_key", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_deal"), "evidence_id", "number")
    deal = F.pmod(F.monotonically_increasing_id(), F.col("_deals")).cast("int").alias("_deal")
    dealt = rows.join(deals, F.col("_key").eqNullSafe(F.col("_of"))).select("_key", deal, "row", "_text")

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = dict(zip(right.column("evidence_id").to_pylist(), right.column("number").to_pylist()))
        trie = trie_of(numbers)
        out = [linked(trie, numbers, t.as_py(), marker) for t in left.column("_text")]
        return pa.table({"row": left.column("row"), "linked": pa.array(out, pa.string())})

    schema = rows.select("row").schema.add("linked", "string")
    groups = dealt.groupBy("_key", "_deal").cogroup(known.groupBy("_key", "_deal"))
    return groups.applyInArrow(link, schema).select("row.*", "linked")


def _grams(text: str, size: int) -> Column:
    return F.expr(f"transform(sequence(1, greatest(length({text}) - {size - 1}, 1)), i -> substring({text}, i, {size}))")


def _pieces(texts: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """(key, piece): a text in lower case, cut into pieces that go on by longest - 1 code points, so no alias is cut."""
    step = max(PIECE, longest)
    cut = F.expr(f"regexp_extract_all(lower({text}), '(?s).{{1,{step}}}', 0)")
    on = F.transform("_cut", lambda p, i: F.concat(p, F.coalesce(F.substring(F.get("_cut", i + 1), 1, longest - 1), F.lit(""))))
    return texts.where(F.col(text).isNotNull()).select(F.col(key), cut.alias("_cut")).select(key, F.explode(on).alias("piece"))


def _hashes(codes: np.ndarray, sizes, seed: int) -> dict[int, np.ndarray]:
    """Hashes of all runs of each size, at the place where they begin; a longer run's is made of two shorter ones'."""
    mix = lambda x, y: (x[: len(y)] ^ (x[: len(y)] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + y
    of = {1: (codes.astype(np.uint64) + np.uint64(1 + 2 * seed)) * np.uint64(0xD6E8FEB86659FD93)}
    for size, (x, y) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 6: (4, 2), 8: (4, 4)}.items():
        if size <= max(sizes):
            of[size] = mix(of[x], of[y][x:])
    return {size: of[size] for size in sizes}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Grams:
    """Grams by size and in the order of their hashes, which all differ, with a table of the hashes' leading bits."""

    def __init__(self, grams: list[str]):
        self.of, self.names = {}, []
        for size in sorted({len(g) for g in grams}):
            own = [g for g in grams if len(g) == size]
            for seed in range(64):
                hashes = _hashes(_codes("".join(own)), [size], seed)[size][::size]
                known, order = np.unique(hashes, return_index=True)
                if len(known) == len(own):
                    break
            else:
                raise ValueError("grams occur twice")
            table = np.zeros(1 << TABLE, bool)
            table[known >> np.uint64(64 - TABLE)] = True
            self.of[size] = seed, table, known, len(self.names)
            self.names += [own[i] for i in order]

    def at(self, codes: np.ndarray):
        """(size, places, numbers of grams) of runs that have a gram's hash."""
        for size, (seed, table, known, first) in self.of.items():
            hashes = _hashes(codes, [size], seed)[size]
            at = np.flatnonzero(table[hashes >> np.uint64(64 - TABLE)])
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            same = known[place] == hashes[at]
            yield size, at[same], place[same] + first


def _hits(texts: list[str], grams: Grams):
    """(text, place, size, number) of grams within each text, in arrays, by parts of the texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends, codes = np.cumsum(lengths), _codes("".join(texts))
    for i in range(0, len(codes), AT_A_TIME):
        for size, at, number in grams.at(codes[i : i + AT_A_TIME + max(grams.of) - 1]):
            number, at = number[at < AT_A_TIME], at[at < AT_A_TIME] + i
            text = np.searchsorted(ends, at, "right")
            inside = at + size <= ends[text]
            yield text[inside], (at - ends[text] + lengths[text])[inside], size, number[inside]


def _parts(batches):
    """Rows and texts of batches (key, low), a few texts or one long one at a time."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for row, text in enumerate(batch.column(1)):
            rows.append(row), texts.append(text.as_py())
            held += len(texts[-1])
            if held >= AT_A_TIME:
                yield batch, rows, texts
                rows, texts, held = [], [], 0
        if rows:
            yield batch, rows, texts


def _gram_counts(batches, grams):
    """(key, low) to (gram, n) of a task's texts."""
    grams = grams.value
    n = np.zeros(len(grams.names), np.int64)
    for _, _, texts in _parts(batches):
        for _, _, _, number in _hits(texts, grams):
            np.add.at(n, number, 1)
    met = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array([grams.names[i] for i in met], pa.string()), pa.array(n[met])], names=["gram", "n"])


def _gram_pieces(batches, grams, step: int, longest: int):
    """(key, low) to (key, piece, gram): grams with the pieces that hold them, each once for a text and piece. Pieces go on by
    longest - 1 code points, so a gram can be in two. A run that only has a gram's hash is found out when pieces are verified."""
    grams = grams.value
    for batch, rows, texts in _parts(batches):
        first = np.cumsum([0, *(len(t) // step + 1 for t in texts)])  # number of each text's first piece
        found = []
        for text, at, size, number in _hits(texts, grams):
            k = at // step
            before = (k > 0) & (at + size <= k * step + longest - 1)
            found += [(first[text] + k) * len(grams.names) + number, (first[text] + k - 1)[before] * len(grams.names) + number[before]]
        if not found:
            continue
        piece, number = np.divmod(np.unique(np.concatenate(found)), len(grams.names))
        text = np.searchsorted(first, piece, "right") - 1
        start = (piece - first[text]) * step
        keys = batch.column(0).take(pa.array(np.array(rows)[text]))
        pieces = [texts[t][i : i + step + longest - 1] for t, i in zip(text.tolist(), start.tolist())]
        named = pa.array([grams.names[i] for i in number.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([keys, pa.array(pieces, pa.string()), named], names=["key", "piece", "gram"])


def _few_mentions(texts: DataFrame, names: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """`alias_mentions` of aliases whose keys every task can hold: tasks look the texts through for the keys' hashes, and only
    pieces with a key leave them. Texts stay where they are."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = texts.sparkSession
    low = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("low"))
    size = F.lit(SIZES[0])
    for n in SIZES[1:]:
        size = F.when(F.length("alias") >= n, n).otherwise(size)
    sized = names.select("alias", size.alias("size"))
    each = F.array_distinct(F.expr(f"transform(sequence(1, least(length(alias), {HEAD}) - size + 1), i -> substring(alias, i, size))"))
    parts = staged(sized.select("alias", F.explode(each).alias("gram")), "alias-grams")

    def sent(df: DataFrame):
        return spark.sparkContext.broadcast(Grams(df.select("gram").distinct().toArrow().column("gram").to_pylist()))  # HEAD an alias at most

    counts = low.mapInArrow(partial(_gram_counts, grams=sent(parts)), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = F.broadcast(staged(counts, "gram-counts"))
    rarest = parts.join(counts, "gram", "left").groupBy("alias").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    rarest = staged(rarest, "alias-keys")
    schema = low.select("key").schema.add("piece", "string").add("gram", "string")
    seen = low.mapInArrow(partial(_gram_pieces, grams=sent(rarest), step=max(SHORT, longest), longest=longest), schema)
    met = seen.join(F.broadcast(rarest), "gram").where(F.contains("piece", F.col("alias")))
    return met.select(F.col("key").alias(key), "alias").distinct()


def alias_mentions(texts: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alias) of every alias that a text has, in any case and within longer words too, each pair once.

    aliases: (alias), of any number. The key of an alias is its rarest gram, counted over all texts; grams of the texts meet
    the keys by equality, and what meets is verified. Up to FEW aliases, grams have up to the most of SIZES code points that
    fit, and the texts are looked through where they are; of more, they have GRAM and the texts' grams shuffle. Null texts,
    null and empty aliases mention nothing; aliases that differ in case alone are one, in lower case."""
    names = staged(aliases.select(F.lower("alias").alias("alias")).where("alias != ''").distinct(), "aliases")
    shape = names.agg(F.max(F.length("alias")), F.collect_set(F.least(F.length("alias"), F.lit(GRAM))), F.count(F.lit(1))).first()
    longest, sizes, count = shape[0] or 1, sorted(shape[1]), shape[2]
    if 0 < count <= FEW:
        return _few_mentions(texts, names, key, text, longest)
    pieces = _pieces(texts, key, text, longest)
    own = F.least(F.length("alias"), F.lit(GRAM))
    each = F.array_distinct(F.expr(f"transform(sequence(1, length(alias) - least(length(alias), {GRAM}) + 1), i -> substring(alias, i, least(length(alias), {GRAM})))"))
    parts = staged(names.select("alias", own.alias("size"), F.explode(each).alias("gram")), "alias-grams")
    seen = None
    for size in sizes:
        grams = pieces.select(key, "piece", F.explode(_grams("piece", size)).alias("gram"))
        seen = grams if seen is None else seen.unionAll(grams)
    if seen is None:
        return pieces.select(key, F.lit("").alias("alias")).limit(0)
    wanted = parts.select("gram").distinct()
    counts = staged(seen.select("gram").join(wanted, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    rarest = parts.join(counts, "gram", "left").groupBy("alias").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = seen.join(staged(rarest, "alias-keys"), "gram").where(F.contains("piece", F.col("alias")))
    return met.select(key, "alias").distinct()
