"""Near-duplicate embeddings by an inverted-list index with product-quantised residuals.

Vectors are scaled to length 1, so cosine c is squared distance 2 - 2c. A coarse quantiser of two levels,
fitted on a bounded sample, puts every vector into one list; its residual is coded per subspace. A query
probes lists by a bound: two vectors within distance r whose nearest centroids of a level are a and c
satisfy d(x,c)^2 - d(x,a)^2 <= 2 r d(a,c), so probes by the whole radius lose nothing (`exact`). By default
the radius counts by the share of a difference that can point across a border, as measured on the sample.
In a list, distances of many queries to all codes are one matrix product with the vectors that the codes stand for; the triangle
inequality with the stored coding error keeps every member that can be close enough, and those are ranked by exact cosine.

Lists in a row are compared together: a query goes once to such a cell, with the lists that it probes there. Cells are dealt
to rounds that shuffle about ROUND rows a vector and drop their shuffle files, so disk follows the vectors, not the probes."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .staging import in_batches, release, shuffles_dropped, stage
from .tables import read

#: Vectors a list is meant for; vectors that the index is fitted on for each list, and at least.
LIST, PER_LIST, LEAST_FITTED = 256, 4, 8192
#: Bounds of the fitted sample, in expectation: its vectors, and its bytes as doubles. Lists are a fourth of it at most.
MAX_FITTED, FITTED_BYTES = 262_144, 128 << 20
#: Lists below one centroid of the upper level; subspaces, codes and rounds of fitting.
WIDE, SUBSPACES, CODES, ROUNDS = 256, 8, 256, 6
#: Standard deviations of a difference's direction across a border, and the quantile of measured ones, that probes allow for.
SPREAD, QUANTILE = 2.5, 0.995
#: Most members, and most queries, that one task compares at a time, and their bytes as doubles: lists in a row share such a
#: block, a larger list is cut into several. Blocks of members that a table has at least, if it has as many lists.
BLOCK, BLOCK_BYTES, CELLS = 65_536, 32 << 20, 16
#: Rows that one round of comparisons shuffles for each vector, about; tables of fewer bytes have one round.
ROUND, ROUND_BYTES = 2, 128 << 20
#: Distances, and links, that a task holds at a time.
DISTANCES, LINKS = 1 << 20, 1 << 21
SLACK = 1e-7


def unit_rows(vectors) -> np.ndarray:
    """Vectors as double rows of length 1, whatever their scale."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[i : i + 2048], y).argmin(1) for i in range(0, len(x), 2048)])


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct sample rows; a centroid without rows stays where it is."""
    centre = x[np.random.RandomState(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(x, centre)
        n = np.bincount(nearest, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


class Index:
    """Centroids of two levels, codebooks of residuals for each run of dimensions, and the share of a radius that probes reach."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, exact: bool = False):
        self.top = _means(sample, -(-lists // WIDE), 1)
        above = _nearest(sample, self.top)
        self.sub = []
        for t in range(len(self.top)):
            rows = sample[above == t]
            k = min(len(rows), max(1, round(lists * len(rows) / len(sample))))
            self.sub.append(_means(rows, k, 2 + t) if k else self.top[t : t + 1])
        self.first = np.cumsum([0, *map(len, self.sub)])
        self.centre = np.concatenate(self.sub)
        some = sample[:LEAST_FITTED]
        residual = some - self.centre[self.own(some)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_means(residual[:, c], CODES, 2 + i) for i, c in enumerate(self.cuts)]
        self.radius = float(np.sqrt(2 - 2 * cosine)) + SLACK
        self.share = 1.0 if exact else self._share(some, cosine)

    def _share(self, some: np.ndarray, cosine: float) -> float:
        """How much of a difference points from a centroid to one near it: by the spread of such directions along
        their main axis, and by the links of the sample itself if it has any."""
        if len(self.centre) < 2:
            return 1.0
        at = np.random.RandomState(0).permutation(len(self.centre))[:1024]
        others = np.argsort(_squared(self.centre[at], self.centre), axis=1)[:, 1:17]
        way = self.centre[others] - self.centre[at][:, None]
        way = (way / np.maximum(np.linalg.norm(way, axis=2, keepdims=True), 1e-12)).reshape(-1, some.shape[1])
        share = SPREAD * np.sqrt(np.linalg.eigvalsh(way.T @ way / len(way))[-1])
        found = []
        for i in range(0, len(some), 1024):
            p, q = np.nonzero(some[i : i + 1024] @ some.T >= cosine)
            p, q = p[p + i < q][:512] + i, q[p + i < q][:512]
            apart = np.linalg.norm(some[q] - some[p], axis=1)
            p, q, apart = p[apart > 1e-6], q[apart > 1e-6], apart[apart > 1e-6]
            if len(p):
                own = self.own(some[p])
                near = np.argsort(_squared(self.centre[own], self.centre), axis=1)[:, 1:9]
                ways = self.centre[near] - self.centre[own][:, None]
                length = np.maximum(np.linalg.norm(ways, axis=2), 1e-12)
                found.append(np.abs(np.einsum("ij,ikj->ik", some[q] - some[p], ways) / length / apart[:, None]).ravel())
        if found:
            share = max(share, np.quantile(np.concatenate(found), QUANTILE))
        return float(min(1.0, share))

    def own(self, x: np.ndarray) -> np.ndarray:
        """List of each row: the nearest centroid below the nearest one of the upper level."""
        above, out = _nearest(x, self.top), np.empty(len(x), np.int64)
        for t in np.unique(above):
            out[above == t] = self.first[t] + _nearest(x[above == t], self.sub[t])
        return out

    def coded(self, x: np.ndarray):
        """Own list, codes and coding error."""
        own = self.own(x)
        residual = x - self.centre[own]
        codes = np.stack([_squared(residual[:, c], b).argmin(1) for c, b in zip(self.cuts, self.books)], axis=1)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), np.linalg.norm(residual - decoded, axis=1)

    def _within(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Which centroids can be the nearest of a vector within reach of each row."""
        d, apart = _squared(x, centres), np.sqrt(_squared(centres, centres))
        nearest = d.argmin(1)
        return d - d[np.arange(len(x)), nearest][:, None] <= 2 * self.radius * self.share * apart[nearest]

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): lists that can hold a vector within reach of each row, by rows."""
        above, rows, lists = self._within(x, self.top), [], []
        for t in np.flatnonzero(above.any(axis=0)):
            at = np.flatnonzero(above[:, t])
            row, j = np.nonzero(self._within(x[at], self.sub[t]))
            rows.append(at[row]), lists.append(self.first[t] + j)
        row, to = np.concatenate(rows), np.concatenate(lists)
        order = np.argsort(row, kind="stable")
        return row[order], to[order]

    def decoded(self, at: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that a list's codes stand for, and the product with each from which a query of length 1 can be within
        the radius of its member: single precision, less what rounding can add to such a product."""
        found = self.centre[at] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        squared = (found * found).sum(1)
        rounding = (found.shape[1] + 8) * np.finfo(np.float32).eps * (1 + squared)
        return found.astype(np.float32), ((1 + squared - (self.radius + error) ** 2) / 2 - rounding).astype(np.float32)


def _placed(batches, index):
    """(rep, n, embedding) to (rep, n, embedding, list, code, error, probes)."""
    index = index.value
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            x = _matrix(part.column(2))
            own, codes, error = index.coded(x)
            row, to = index.probes(x)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(x)))))
            probes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(to, pa.int32()))
            columns = [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes]), pa.array(error), probes]
            names = ["rep", "n", "embedding", "list", "code", "error", "probes"]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=names)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        was = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (was == label).all():
            return nodes, nodes[label]


class Cells:
    """Lists in a row as cells of about `per` members; blocks of members and of queries in each, and the round that compares it."""

    def __init__(self, members: np.ndarray, per: int, dims: int = 1):
        self.most = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
        per = max(1, min(per, self.most))
        self.of, cell, held = np.empty(len(members), np.int32), -1, per
        for at, n in enumerate(members):
            if held + n > per:
                cell, held = cell + 1, 0
            self.of[at], held = cell, held + n
        self.members = np.bincount(self.of, members, cell + 1).astype(np.int64)

    def deal(self, queries: np.ndarray, most: int) -> int:
        """Blocks and rounds, given each cell's queries and the rows of a round; how many rounds there are."""
        self.ms, self.qs = (-(-n // self.most) * (self.members > 0) * (queries > 0) for n in (self.members, queries))
        self.round, last, held = np.zeros(len(queries), np.int32), 0, 0
        for at, n in enumerate(self.members * self.qs + queries * self.ms):
            if held and held + n > most:
                last, held = last + 1, 0
            self.round[at], held = last, held + n
        return last + 1


def _asks(probes, of: np.ndarray):
    """Rows and cells that they probe, each pair once, and the lists probed there."""
    flat = probes.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(probes)), np.diff(probes.offsets.to_numpy()))
    cell = of[flat]
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))  # lists of a row ascend
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(flat)), pa.int32()), pa.array(flat, pa.int32()))
    return row[new], cell[new], lists


def _counted(batches, cells):
    """(probes) to (cell, n): queries of each cell."""
    cells = cells.value
    n = np.zeros(len(cells.members), np.int64)
    for batch in batches:
        n += np.bincount(_asks(batch.column(0), cells.of)[1], minlength=len(n))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], names=["cell", "n"])


def _times(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place n times, and the number of the time."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _dealt(batches, cells, number: int):
    """Placed rows to members and queries of a round's blocks."""
    cells = cells.value
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            rep, home = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            mix = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = lambda row, n: (mix[row] % n.astype(np.uint64)).astype(np.int32)
            row = np.flatnonzero(cells.round[cells.of[home]] == number)
            at, q = _times(cells.qs[cells.of[home[row]]])
            held = row[at]
            asking, cell, lists = _asks(batch.column(6), cells.of)
            some = np.flatnonzero(cells.round[cell] == number)
            at, m = _times(cells.ms[cell[some]])
            some = some[at]
            asked, cell = asking[some], np.concatenate((cells.of[home[held]], cell[some]))
            both, inside = np.concatenate((held, asked)), np.arange(len(held) + len(asked)) < len(held)
            if not len(both):
                continue
            split = len(held)
            m = np.concatenate((own(held, cells.ms[cell[:split]]), m))
            q = np.concatenate((q, own(asked, cells.qs[cell[split:]])))
            rows, only = pa.array(both), pa.array(np.where(inside, both, 0), mask=~inside)  # codes go with members alone
            nothing = pa.nulls(split, lists.type)
            columns = [pa.array(cell, pa.int32()), pa.array(m, pa.int32()), pa.array(q, pa.int32()), pa.array(inside), batch.column(0).take(rows), batch.column(1).take(rows),
                       batch.column(3).take(rows), batch.column(2).take(rows), batch.column(4).take(only), batch.column(5).take(only), pa.concat_arrays([nothing, lists.take(pa.array(some))])]
            yield pa.RecordBatch.from_arrays(columns, names=_DEALT)


_DEALT = ["cell", "m", "q", "member", "rep", "n", "home", "embedding", "code", "error", "lists"]


class _Links:
    """Links of a block's rows: their numbers by vector, and a spanning forest."""

    def __init__(self, index: Index, ids: np.ndarray, n: np.ndarray, home: np.ndarray, x: np.ndarray):
        self.index, self.n, self.home, self.x = index, n, home, x
        self.nodes, self.node = np.unique(ids, return_inverse=True)
        self.links, self.label = np.zeros(len(self.nodes), np.int64), np.arange(len(self.nodes))
        self.met, self.open, self.held = np.zeros(len(self.nodes), bool), [], 0

    def add(self, q: np.ndarray, m: np.ndarray) -> None:
        self.open.append((q, m))
        self.held += len(q)
        if self.held > LINKS:
            self.fold()

    def fold(self) -> None:
        """A link counts for its query, and for its member too if the member does not probe the query's list itself."""
        if not self.held:
            return
        q, m = (np.concatenate(z) for z in zip(*self.open))
        self.open, self.held, index = [], 0, self.index
        a, b = self.node[q], self.node[m]
        np.add.at(self.links, a, self.n[m])
        self.met[a] = self.met[b] = True
        if index.share < 1:
            some, which = np.unique(m, return_inverse=True)
            row, to = index.probes(self.x[some])
            lists = len(index.centre)
            alone = ~np.isin(which * lists + self.home[q], row * lists + to)
            np.add.at(self.links, b[alone], self.n[q[alone]])
        u, v = self.label[a], self.label[b]
        if (u != v).any():
            joined, root = _forest(u[u != v], v[u != v])
            to = np.arange(len(self.nodes))
            to[joined] = root
            self.label = to[self.label]

    def table(self) -> pa.Table:
        self.fold()
        found = [self.nodes[self.met], self.links[self.met], self.nodes[self.label[self.met]]]
        return pa.table(dict(zip(("rep", "links", "root"), (pa.array(c, pa.int64()) for c in found))))


def _compared(key, table, index, cosine: float):
    """One block of a cell's members against one block of its queries: (rep, links, root) of linked vectors."""
    index = index.value
    table = table.combine_chunks()
    member = table.column("member").to_numpy()
    ids, n, home, x = *(table.column(c).to_numpy() for c in ("rep", "n", "home")), _matrix(table.column("embedding"))
    held = np.flatnonzero(member)[np.argsort(home[member], kind="stable")]
    inside = table.select(["code", "error"]).take(pa.array(held))
    codes = np.frombuffer(b"".join(inside.column("code").to_pylist()), np.uint8).reshape(len(held), -1)
    error = inside.column("error").to_numpy()
    probed = table.column("lists").filter(pa.array(~member)).combine_chunks()
    asking = np.repeat(np.flatnonzero(~member), np.diff(probed.offsets.to_numpy()))
    to = probed.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(to, kind="stable")
    asking, to = asking[order], to[order]
    links, short = _Links(index, ids, n, home, x), x.astype(np.float32)
    lists, first = np.unique(home[held], return_index=True)
    for at, a, b in zip(lists, first, np.append(first[1:], len(held))):
        mine, queries = held[a:b], asking[np.searchsorted(to, at) : np.searchsorted(to, at, "right")]
        decoded, least = index.decoded(at, codes[a:b], error[a:b])
        step = max(1, DISTANCES // len(mine))
        for i in range(0, len(queries), step):
            some = queries[i : i + step]
            q, m = np.divmod(np.flatnonzero(short[some] @ decoded.T >= least), len(mine))
            q, m = some[q], mine[m]
            q, m = q[ids[q] != ids[m]], m[ids[q] != ids[m]]
            for j in range(0, len(q), 65536):
                close = np.einsum("ij,ij->i", x[q[j : j + 65536]], x[m[j : j + 65536]]) >= cosine
                links.add(q[j : j + 65536][close], m[j : j + 65536][close])
    return links.table()


def fit(vectors: DataFrame, dims: int, cosine: float = 0.95, exact: bool = False, a_list: int = LIST) -> Index:
    """Index of (rep, embedding), usable vectors of `dims` dimensions: a list for each `a_list`, fitted on the vectors with
    the lowest hashes, about PER_LIST a list within MAX_FITTED and FITTED_BYTES."""
    total = vectors.count()
    bound = max(min(MAX_FITTED, FITTED_BYTES // (8 * dims)), CODES)
    most = min(bound, max(LEAST_FITTED, PER_LIST * (total // a_list)))
    known = vectors.select("rep", "embedding")
    if total > most:
        order = F.xxhash64("rep", F.lit("index sample"))
        known = known.where(order < F.lit(int(-(2**63) + 2**64 * (most / total))))
    sample = known.orderBy("rep").toArrow()  # bounded by `most`
    if not len(sample):  # the hashes left none
        sample = vectors.select("rep", "embedding").orderBy("rep").limit(CODES).toArrow()
    rows = _matrix(sample.column("embedding"))
    rows = rows[np.random.RandomState(3).permutation(len(rows))]
    return Index(rows, int(max(1, min(total // a_list, bound // PER_LIST, len(rows)))), cosine, exact)


def _placed_rows(known: DataFrame, index) -> DataFrame:
    kind = known.schema["embedding"].dataType.simpleString()
    schema = f"rep long, n long, embedding {kind}, list int, code binary, error double, probes array<int>"
    return stage(in_batches(known.select("rep", "n", "embedding"), partial(_placed, index=index), schema), "placed", **_PLAIN)


def _linked(placed: DataFrame, index, dims: int, cosine: float) -> DataFrame:
    """(rep, links, root) of linked vectors among `placed` rows, all usable and of one length."""
    spark, total = placed.sparkSession, placed.count()
    held = placed.groupBy("list").count().toArrow()  # a row per list, at most a fourth of MAX_FITTED
    members = np.zeros(len(index.value.centre), np.int64)
    members[held.column("list").to_numpy()] = held.column("count").to_numpy()
    cells = Cells(members, total // CELLS, dims)
    counted = in_batches(placed.select("probes"), partial(_counted, cells=spark.sparkContext.broadcast(cells)), "cell int, n long")
    asked = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row per cell
    queries = np.zeros(len(cells.members), np.int64)
    queries[asked.column("cell").to_numpy()] = asked.column("n").to_numpy()
    rounds = cells.deal(queries, max(ROUND * total, ROUND_BYTES // (8 * dims)))
    sent = spark.sparkContext.broadcast(cells)
    kind = placed.schema["embedding"].dataType.simpleString()
    schema = f"cell int, m int, q int, member boolean, rep long, n long, home int, embedding {kind}, code binary, error double, lists array<int>"

    def compare(key, table):
        return _compared(key, table, index, cosine)

    linked = None
    for number in range(rounds):
        met = in_batches(placed, partial(_dealt, cells=sent, number=number), schema).groupBy("cell", "m", "q")
        some = stage(met.applyInArrow(compare, "rep long, links long, root long"), "linked")
        linked = some if linked is None else linked.unionAll(some)
    return linked


#: Components hardly repeat, so a dictionary of them costs more than it saves.
_PLAIN = {"parquet.enable.dictionary": "false"}


def _links_of(vectors: DataFrame, cosine: float, exact: bool) -> tuple[DataFrame, ...]:
    """(vec_id, dims, h1, h2), (dims, h1, h2, rep, n), (rep, links, root) and (rep, component). Embeddings are staged as vectors,
    as distinct vectors and as placed ones, and each is deleted when the next is there."""
    whole = stage(vectors, "vectors", **_PLAIN)
    vectors = stage(whole.select("vec_id", "dims", "h1", "h2"), "vector-ids")
    distinct = whole.where("dims IS NOT NULL").groupBy("dims", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    distinct = stage(distinct, "distinct-vectors", **_PLAIN)
    release(whole)
    copies = stage(distinct.select("dims", "h1", "h2", "rep", "n"), "distinct-ids")
    lengths = sorted(r.dims for r in copies.groupBy("dims").count().where("count > 1").collect())  # a row per length
    placed = []
    for k in lengths:
        known = distinct.where(F.col("dims") == k)
        index = vectors.sparkSession.sparkContext.broadcast(fit(known, k, cosine, exact))
        placed.append((_placed_rows(known, index), index, k))
    release(distinct)
    linked = vectors.sparkSession.createDataFrame([], "rep long, links long, root long")
    for rows, index, k in placed:
        linked = linked.unionAll(_linked(rows, index, k, cosine))
        release(rows)
    return vectors, copies, linked, connected_components(linked, "rep", "root").withColumnRenamed("node", "rep")


def near_duplicate_vectors(table: DataFrame, cosine: float = 0.95, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vec_id of (vec_id, embedding): links at `cosine` or above.

    n_links counts the other vectors that a vector is within `cosine` of, component_id is the smallest
    vec_id reachable by links, kept marks that vector. Vectors that are null, empty or zero or hold null or
    non-finite components link with nothing, and others with vectors of their own length only. A vec_id that
    comes in several rows is one vector, the smallest of its embeddings; null vec_ids are left out; an
    empty table gives no rows. Copies are one row with their number, however many. In a crowded list, blocks
    of members meet blocks of queries and give back counts and a spanning forest, so no task holds more than
    a block of each and no pair leaves it. `exact` probes by the whole radius and loses no link."""
    usable = F.expr("""size(embedding) > 0 AND exists(embedding, v -> v <> 0)
        AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(CAST(v AS double)) < double('Infinity'))""")
    vectors = table.where(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min("embedding").alias("embedding"))
    dims = F.when(F.coalesce(usable, F.lit(False)), F.size("embedding"))
    digest = [F.xxhash64(F.lit(salt), "embedding").alias(f"h{salt}") for salt in (1, 2)]
    with shuffles_dropped(table.sparkSession):
        vectors, copies, linked, groups = _links_of(vectors.select("vec_id", "embedding", dims.alias("dims"), *digest), cosine, exact)
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = copies.join(counts, "rep", "left").join(groups, "rep", "left")
    found = vectors.join(of_rep, ["dims", "h1", "h2"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return found.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
