"""Vector codes by product quantisation in integers, with Lloyd's rounds over two trees.

Vectors are cut into parts, and each part position has a codebook. Blocks of vectors are staged once with a k-d tree
over each part: boxes, and sums of all points below a node. A round builds a small tree over a codebook's entries and
walks pairs of nodes, one of points and one of entries, level by level: a pair is dropped if the least distance of its
boxes is above the largest distance from the points to some other pair's entries. Points that are left with one entry
are counted as a whole node, by its cached sum; leaves with several are decided point by point. Everything is in
integers, so bounds are exact and ties go to the lower index whatever the blocks are.

Spark deals out the blocks and adds up each round's sums by (part, entry, position); the driver has the codebooks
alone, which the table's length doesn't change."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .staging import in_batches, release, stage
from .tables import read

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of a block of vectors (vectors at most); points of a leaf.
BLOCK, MOST_ROWS, LEAF = 1 << 19, 8192, 24
#: Largest size of a scaled component, and of a vector's length: squares of differences of a part then fit a long.
RANGE, LONGEST = 1 << 24, 1 << 16
#: Numbers that a leaf's comparison holds at a time; labels that a join may send to every task.
AT_ONCE, FEW_LABELS = 1 << 20, 100_000


def _cuts(length: int, parts: int = PARTS) -> list[slice]:
    """Consecutive parts of a vector, equal if `parts` divides its length, else the first ones longer by one."""
    ends = np.cumsum([length // parts + (k < length % parts) for k in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends[:-1]], ends)]


def _splits(n: int, depth: int) -> np.ndarray:
    """Where the 2 ** depth nodes of a level begin, and n."""
    return np.arange((1 << depth) + 1, dtype=np.int64) * n >> depth


def _depth(n: int) -> int:
    return max(0, (max(n, 1) - 1) // LEAF).bit_length()


class PointTree:
    """A k-d tree over the rows of an integer matrix: `order` of the rows, and lo, hi and sums by level."""

    def __init__(self, points, order, levels):
        self.points, self.order, self.levels = points, order, levels

    @classmethod
    def built(cls, points: np.ndarray) -> PointTree:
        n, depth = len(points), _depth(len(points))
        order = np.arange(n, dtype=np.int32)
        for level in range(depth):
            ends, below = _splits(n, level), _splits(n, level + 1)
            for k in range(1 << level):
                own = order[ends[k] : ends[k + 1]]
                x = points[own]
                widest = int((x.max(0) - x.min(0)).argmax())
                own[:] = own[np.argpartition(x[:, widest], below[2 * k + 1] - ends[k])]
        points = points[order]
        starts = _splits(n, depth)[:-1]
        levels = [tuple(f.reduceat(points, starts) for f in (np.minimum, np.maximum, np.add))]
        for _ in range(depth):
            levels.append(tuple(f(x[::2], x[1::2]) for f, x in zip((np.minimum, np.maximum, np.add), levels[-1])))
        return cls(points, order, levels[::-1])

    def packed(self) -> bytes:
        boxes = b"".join(x.astype(np.int32).tobytes() for lo, hi, _ in self.levels for x in (lo, hi))
        sums = b"".join(s.tobytes() for _, _, s in self.levels)
        return self.points.astype(np.int32).tobytes() + self.order.tobytes() + boxes + sums

    @classmethod
    def unpacked(cls, data: bytes, n: int, width: int) -> PointTree:
        at = 0

        def take(rows, columns, kind):
            nonlocal at
            out = np.frombuffer(data, kind, rows * columns, at).reshape(rows, columns)
            at += out.nbytes
            return out.astype(np.int64)

        points, order, depth = take(n, width, np.int32), take(n, 1, np.int32)[:, 0], _depth(n)
        boxes = [[take(1 << k, width, np.int32) for _ in range(2)] for k in range(depth + 1)]
        return cls(points, order, [(lo, hi, take(1 << k, width, np.int64)) for k, (lo, hi) in enumerate(boxes)])


class EntryTree:
    """A binary tree over a codebook's distinct entries, each under its lowest index; a leaf is one entry."""

    def __init__(self, book: np.ndarray):
        first: dict[bytes, int] = {}
        for k, entry in enumerate(book):
            first.setdefault(entry.tobytes(), k)
        self.book, self.lo, self.hi, self.children, self.entry = book, [], [], [], []
        self._add(np.array(sorted(first.values()), dtype=np.int64))
        self.lo, self.hi, self.children, self.entry = map(np.array, (self.lo, self.hi, self.children, self.entry))
        self.wide = ((self.hi - self.lo) ** 2).sum(1)

    def _add(self, own: np.ndarray) -> int:
        x, k = self.book[own], len(self.lo)
        self.lo.append(x.min(0))
        self.hi.append(x.max(0))
        self.children.append((0, 0))
        self.entry.append(int(own[0]) if len(own) == 1 else -1)
        if len(own) > 1:
            axis = int((self.hi[k] - self.lo[k]).argmax())
            own = own[np.argsort(x[:, axis], kind="stable")]
            self.children[k] = (self._add(own[: len(own) // 2]), self._add(own[len(own) // 2 :]))
        return k


def _groups(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values of a sorted array begins, and how long it is."""
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return starts, np.diff(np.r_[starts, len(p)])


def _pruned(lo, hi, tree: EntryTree, p, e, last: bool):
    """Pairs (p, e) of nodes of one level and of entries that are left; entries are split that are wider than their points, or all at `last`."""
    wide = ((hi - lo) ** 2).sum(1)
    while True:
        plo, phi, elo, ehi = lo[p], hi[p], tree.lo[e], tree.hi[e]
        least = (np.maximum(0, np.maximum(elo - phi, plo - ehi)) ** 2).sum(1)
        most = (np.maximum(phi - elo, ehi - plo) ** 2).sum(1)
        starts, sizes = _groups(p)
        keep = least <= np.repeat(np.minimum.reduceat(most, starts), sizes)
        p, e = p[keep], e[keep]
        split = (tree.entry[e] < 0) & (last | (tree.wide[e] >= wide[p]))
        if not split.any():
            return p, e
        p, e = np.repeat(p, 1 + split), np.repeat(e, 1 + split)
        at = np.flatnonzero(np.repeat(split, 1 + split))
        e[at] = tree.children[e[at[::2]]].ravel()


def assigned(points: PointTree, book: np.ndarray):
    """Yields (entry, first, end, sum) of runs of points in tree order that go to one entry, and at last (entries, rows) of the others."""
    n, tree = len(points.points), EntryTree(book)
    p, e = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for level, (lo, hi, sums) in enumerate(points.levels):
        last, ends = level == len(points.levels) - 1, _splits(n, level)
        p, e = _pruned(lo, hi, tree, p, e, last)
        starts, sizes = _groups(p)
        alone = (sizes == 1) & (tree.entry[e[starts]] >= 0)
        for node, entry in zip(p[starts[alone]].tolist(), tree.entry[e[starts[alone]]].tolist()):
            yield entry, int(ends[node]), int(ends[node + 1]), sums[node]
        rest = np.repeat(~alone, sizes)
        p, e = p[rest], e[rest]
        if not len(p):
            return
        if not last:  # the children of each node keep its pairs
            starts, sizes = _groups(p)
            twice = np.repeat(sizes, 2)
            p = np.repeat(np.repeat(p[starts], 2) * 2 + np.tile([0, 1], len(starts)), twice)
            e = e[np.arange(len(p)) - np.repeat(np.cumsum(twice) - twice, twice) + np.repeat(np.repeat(starts, 2), twice)]
    yield from _leaves(points.points, ends, book, p, tree.entry[e])


def _leaves(points, ends, book, p, entries):
    """Each point of the leaves p against the leaf's own entries, by exact distances."""
    starts, sizes = _groups(p)
    leaves = p[starts]
    rows = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in leaves])
    many = ends[leaves + 1] - ends[leaves]
    first, count = np.repeat(starts, many), np.repeat(sizes, many)
    step = max(1, AT_ONCE // (max(1, points.shape[1]) * int(sizes.max())))
    for k in range(0, len(rows), step):
        at, c = rows[k : k + step], count[k : k + step]
        offsets = np.cumsum(c) - c
        who = entries[np.arange(c.sum()) - np.repeat(offsets, c) + np.repeat(first[k : k + step], c)]
        d = ((points[np.repeat(at, c)] - book[who]) ** 2).sum(1)
        nearest = d == np.repeat(np.minimum.reduceat(d, offsets), c)
        yield np.minimum.reduceat(np.where(nearest, who, len(book)), offsets), at


def _scaled(vector: str) -> str:
    return f"transform({vector}, x -> floor({SCALE}D * CAST(x AS double)))"


_BLOCK = [StructField("n", LongType()), StructField("trees", ArrayType(BinaryType()))]


def _blocks(vectors: DataFrame, length: int) -> DataFrame:
    """Staged blocks (n, trees, vec_id, label) of vectors (vec_id, label, x); ids and labels are in the rows' order."""
    cuts, most = _cuts(length), max(64, min(MOST_ROWS, BLOCK // max(1, length)))
    fields = [StructField(c, ArrayType(vectors.schema[c].dataType)) for c in ("vec_id", "label")]
    schema = StructType(_BLOCK + fields)

    def build(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                cut = batch.slice(at, most)
                x = cut.column(2)
                x = np.asarray(x.flatten(), dtype=np.int64).reshape(len(x), length)
                trees = [PointTree.built(x[:, c]).packed() for c in cuts]
                rows = [pa.array([cut.num_rows], pa.int64()), pa.array([trees], pa.list_(pa.binary()))]
                rows += [pa.ListArray.from_arrays(pa.array([0, cut.num_rows], pa.int32()), cut.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(rows, names=["n", "trees", "vec_id", "label"])

    # row groups of few blocks, so that no reader holds many
    small = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    return stage(in_batches(vectors.select("vec_id", "label", "x"), build, schema), "vector-blocks", **small)


def _trees(batch: pa.RecordBatch, cuts):
    """(n, trees) of each block of a batch."""
    for n, trees in zip(batch.column("n").to_pylist(), batch.column("trees").to_pylist()):
        yield n, [PointTree.unpacked(t, n, c.stop - c.start) for t, c in zip(trees, cuts)]


def _summed(blocks: DataFrame, books: list[np.ndarray], length: int) -> dict:
    """{(part, entry): (count, sums)} of the points that each entry gets."""
    cuts = _cuts(length)

    def sums(batches):
        found = defaultdict(lambda: [0, 0])
        for batch in batches:
            for _, trees in _trees(batch, cuts):
                for part, (tree, book) in enumerate(zip(trees, books)):
                    for got in assigned(tree, book):
                        if len(got) == 4:
                            entry, first, end, total = got
                            held = found[part, entry]
                            held[0] += end - first
                            held[1] = held[1] + total
                            continue
                        for entry in np.unique(got[0]).tolist():
                            own = got[1][got[0] == entry]
                            held = found[part, entry]
                            held[0] += len(own)
                            held[1] = held[1] + tree.points[own].sum(0)
        rows = [(part, k, at, n, s) for (part, k), (n, total) in found.items() for at, s in enumerate([0, *np.asarray(total).tolist()])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["part", "entry", "at", "n", "s"])

    rows = in_batches(blocks.select("n", "trees"), sums, "part long, entry long, at long, n long, s long")
    total = rows.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict = defaultdict(lambda: [0, {}])
    for r in total.toLocalIterator():  # ENTRIES sums a component, whatever the table's length
        out[r.part, r.entry][0] = r.n
        out[r.part, r.entry][1][r.at] = int(r.s)
    return {k: (n, [s[at] for at in range(1, len(s))]) for k, (n, s) in out.items()}


def _coded(blocks: DataFrame, books: list[np.ndarray], length: int, schema: StructType) -> DataFrame:
    cuts = _cuts(length)

    def code(batches):
        for batch in batches:
            for k, (n, trees) in enumerate(_trees(batch, cuts)):
                codes, error = np.zeros((n, PARTS), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for part, (tree, book) in enumerate(zip(trees, books)):
                    best = np.empty(n, dtype=np.int64)
                    for got in assigned(tree, book):
                        if len(got) == 4:
                            best[got[1] : got[2]] = got[0]
                        else:
                            best[got[1]] = got[0]
                    codes[tree.order, part] = best
                    error[tree.order] += ((tree.points - book[best]) ** 2).sum(1)
                text = codes.tobytes().hex()
                text = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                columns = [batch.column("vec_id")[k].values, batch.column("label")[k].values]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text), pa.array(error)], names=schema.names)

    return in_batches(blocks, code, schema)


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label), and any other columns.

    Rows whose vector is null or holds null or non-finite components are left out; all others have a row, repeated
    ones too. Codebooks start as the parts of the ENTRIES smallest vec_ids (null ids last, equal ones by vector), as many
    as there are. An entry that equals a lower one is never used. label_error sums over equal labels, null ones
    together. Vectors are expected to have one length: those of another than the most frequent one (of equally
    frequent ones the shortest), and those with a component of more than RANGE / SCALE, have null code and error and
    take no part in anything else. Parts are longer by one at the front if PARTS does not divide the length."""
    spark = vectors.sparkSession
    whole = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    kept = vectors.where(whole).select("vec_id", "label", F.expr(_scaled("embedding")).alias("x"))
    inside = f"size(x) <= {LONGEST} AND forall(x, c -> abs(c) <= {RANGE})"
    lengths = kept.where(inside).groupBy(F.size("x").alias("k")).count()
    usual = lengths.orderBy(F.desc("count"), "k").first()
    length = usual.k if usual else 0
    fits = F.expr(f"size(x) = {length} AND {inside}")
    seeds = kept.where(fits).orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()
    start = np.array([r.x for r in seeds], dtype=np.int64).reshape(len(seeds), length)
    books = [start[:, c].copy() for c in _cuts(length)]
    schema = StructType([StructField(c, kept.schema[c].dataType) for c in ("vec_id", "label")] + [StructField("code", StringType()), StructField("error", LongType())])
    found = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    blocks = None
    if seeds:
        blocks = _blocks(kept.where(fits), length)
        for _ in range(rounds):
            for (part, entry), (n, sums) in _summed(blocks, books, length).items():
                books[part][entry] = [s // n for s in sums]
        found = found.unionAll(_coded(blocks, books, length, schema))
    rows = stage(found, "vector-codes")
    if blocks is not None:
        release(blocks)
    text = ",".join(str(v) for book in books for entry in book.tolist() for v in entry)
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    by_label = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    whole_rows = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    digest = hashlib.sha256(text.encode()).hexdigest()
    return whole_rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def _sql_round(k: int) -> str:
    """Codebook k + 1 from codebook k."""
    return f"""d{k} AS (SELECT vec_id, part, e, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN book{k} b USING (part, j) GROUP BY ALL),
  near{k} AS (SELECT vec_id, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{k} GROUP BY ALL),
  sum{k} AS (SELECT part, e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM parts JOIN near{k} USING (vec_id, part) GROUP BY ALL),
  book{k + 1} AS (SELECT part, e, j, coalesce(s.x, b.x) AS x FROM book{k} b LEFT JOIN sum{k} s USING (part, e, j))"""


OP12_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor({SCALE}::DOUBLE * v::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  flat AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) // {PARTS} AS w FROM kept),
  parts AS (SELECT vec_id, (i // w)::INT AS part, (i % w)::INT AS j, x FROM flat),
  seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
  book0 AS (SELECT part, e, j, x FROM parts JOIN seeds USING (vec_id)),
  {", ".join(map(_sql_round, range(ROUNDS + 1)))},
  codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
  sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM kept JOIN codes USING (vec_id) GROUP BY label),
  books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, j)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept JOIN codes USING (vec_id) JOIN sums ON kept.label IS NOT DISTINCT FROM sums.label, books
"""
