"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is a set of paragraph digests: its lines, long ones in pieces, each hashed with the number of times
it occurs. A sketch is a table of three rows of cells; a digest adds to one cell of each row a count, its
bits and a check of its bits. A text's fingerprint is its sketch, as narrow a one as peels: a cell left
with one digest gives it away, taking it out of its other cells uncovers more, until nothing is left. Too
narrow a table leaves cells over and is tried again at twice the width. A table has room for twice its own
digests, so that it can hold a difference too. The tables of two texts are folded to the narrower one's width
and subtracted cell by cell: what both share cancels out, and peeling recovers how they differ. A difference that
is too large for that width is subtracted again at the wider one, for which the narrower table is written out
anew. What is too large even then (one to three pairs in a hundred here) is found by peeling both, which always
succeeds. So likeness follows from the two fingerprints alone. Every step sorts or walks
an array once, so the work follows the length of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import bounds, bucket
from .staging import tasks
from .tables import read

#: Code points of the longest piece of a line; cells of a row of the narrowest sketch.
PIECE, WIDTH = 256, 8
#: Widths tried for a text, each twice the last; rounds of peeling, of which ten or so are needed.
TRIES, ROUNDS = 12, 100


def _let(name: str, value: str, body: str) -> str:
    """SQL of `body` with `name` bound to `value`, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _runs(array: str, same: str, each: str) -> str:
    """SQL that turns each run of a sorted array's elements, equal by `same` of p and q, into `each` of `lo` and `n`."""
    starts = f"filter(sequence(0, size(s) - 1), i -> i = 0 OR NOT {_let('p', 's[i - 1]', _let('q', 's[i]', same))})"
    of_run = f"transform(b, (lo, j) -> {_let('n', 'coalesce(get(b, j + 1), size(s)) - lo', each)})"
    return _let("s", f"sort_array({array})", f"CASE WHEN size(s) = 0 THEN array() ELSE {_let('b', starts, of_run)} END")


def digests_of(text: str) -> str:
    """SQL for the distinct 64-bit digests of a text's paragraphs, each hashed with how often it occurs."""
    pieces = f"regexp_extract_all({text}, '[^\\n]{{1,{PIECE}}}\\n?|\\n', 0)"
    return f"CAST({_runs(f'transform({pieces}, t -> xxhash64(t))', 'p = q', 'xxhash64(s[lo], n)')} AS array<bigint>)"


_CELL = "named_struct('c', {c}, 'n', {n}, 'k', {k}, 'h', {h})"


def _cells(digest: str, sign: str, width: str) -> str:
    """SQL for the three cells that a digest adds to."""
    at = f"CAST(j AS bigint) * {width} + (xxhash64({digest}, j) & ({width} - 1))"
    return f"transform(sequence(0, 2), j -> {_CELL.format(c=at, n=sign, k=digest, h=f'xxhash64({digest})')})"


def _summed(cells: str) -> str:
    """SQL for a table of what an array of cells comes to, by place, without empty ones."""
    add = _CELL.format(c="a.c", n="a.n + s[i].n", k="a.k ^ s[i].k", h="a.h ^ s[i].h")
    run = f"CASE WHEN n = 1 THEN s[lo] ELSE aggregate(sequence(lo + 1, lo + n - 1), s[lo], (a, i) -> {add}) END"
    return f"filter({_runs(cells, 'p.c = q.c', run)}, x -> x.n <> 0 OR x.k <> 0 OR x.h <> 0)"


def table_of(digests: str, width: str) -> str:
    """SQL for the sketch of an array of distinct digests."""
    return _summed(f"flatten(transform({digests}, e -> {_cells('e', '1L', width)}))")


def peeled(cells: str, width: str) -> str:
    """SQL for (cells, found): what peeling leaves of a table, and the digests that it takes out, positive and negative."""
    pure = lambda n: f"array_distinct(transform(filter(z.cells, x -> x.n = {n} AND x.h = xxhash64(x.k)), x -> x.k))"
    out = ", ".join(f"flatten(transform(pure.{c}, y -> {_cells('y', n, width)}))" for c, n in (("more", "-1L"), ("less", "1L")))
    step = f"""CASE WHEN size(pure.more) + size(pure.less) = 0 THEN z ELSE named_struct('cells', {_summed(f"concat(z.cells, {out})")},
        'found', concat(z.found, pure.more, pure.less)) END"""
    step = _let("pure", f"named_struct('more', {pure(1)}, 'less', {pure(-1)})", step)
    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', CAST(array() AS array<bigint>)),
        (z, r) -> CASE WHEN size(z.cells) = 0 THEN z ELSE {step} END)"""


def sketch_of(digests: str) -> str:
    """SQL for (w, cells): the narrowest table, in powers of two, that has 3 cells a digest and peels to nothing."""
    least = f"CAST(greatest({WIDTH}, power(2, ceil(log2(greatest(size(d), 1))))) AS bigint)"
    attempt = _let("t", table_of("d", "v"), f"named_struct('w', v, 'cells', CASE WHEN size({peeled('t', 'v')}.cells) = 0 THEN t END)")
    none = "named_struct('w', 0L, 'cells', CAST(NULL AS array<struct<c: bigint, n: bigint, k: bigint, h: bigint>>))"
    tries = f"aggregate(sequence(0, {TRIES - 1}), {none}, (z0, i0) -> CASE WHEN z0.cells IS NOT NULL THEN z0 ELSE {_let('v', 'shiftleft(w0, i0)', attempt)} END)"
    return _let("d", digests, _let("w0", least, tries))


def printed(sketch: str) -> str:
    """SQL for a sketch as text: its width, then place, count, bits and check of each cell, in hexadecimal."""
    cell = "concat_ws('.', hex(x.c), hex(x.n), hex(x.k), hex(x.h))"
    return f"lower(concat(hex({sketch}.w), ':', array_join(transform({sketch}.cells, x -> {cell}), ',')))"


def _tried(cells: str, how: str) -> str:
    """SQL for (how, found) of a table of differences, null if peeling leaves something."""
    return _let("g", peeled(_summed(cells), "w"), f"CASE WHEN size(g.cells) = 0 THEN named_struct('how', '{how}', 'found', g.found) END")


def difference(made: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """`made` with `out`, (how, found): the digests that one of two sketches has and the other has not, by subtraction and peeling.

    how: `folded` to the narrower width, `widened` to the wider one, or `apart`, each peeled by itself. A later way is
    only gone where the one before it failed."""
    own = lambda x: peeled(f"{x}.cells", f"{x}.w") + ".found"
    placed = lambda cells, place, sign: f"transform({cells}, x -> {_CELL.format(c=place, n=f'{sign} x.n', k='x.k', h='x.h')})"
    folded = lambda x, sign: placed(f"{x}.cells", f"(x.c div {x}.w) * w + (x.c % {x}.w & (w - 1))", sign)
    wide = lambda x, sign: placed(f"CASE WHEN {x}.w = w THEN {x}.cells ELSE {table_of(own(x), 'w')} END", "x.c", sign)
    first = _let("w", f"least({a}.w, {b}.w)", _tried(f"concat({folded(a, '')}, {folded(b, '-')})", "folded"))
    second = _let("w", f"greatest({a}.w, {b}.w)", _tried(f"concat({wide(a, '')}, {wide(b, '-')})", "widened"))
    both = f"named_struct('o', {own(a)}, 'e', {own(b)})"
    last = f"named_struct('how', 'apart', 'found', {_let('p', both, 'concat(array_except(p.o, p.e), array_except(p.e, p.o))')})"
    made = made.withColumn(out, F.expr(first))
    made = made.withColumn(out, F.expr(f"CASE WHEN {out} IS NOT NULL OR {a}.w = {b}.w THEN {out} ELSE {second} END"))
    return made.withColumn(out, F.expr(f"coalesce({out}, {last})"))


def with_next(docs: DataFrame, columns: list[str], more: dict[str, Column]) -> DataFrame:
    """doc_id, `columns`, `more` and next_<column> of the document next in descending doc_id order; the last's is the first.

    `more` are computed from `columns` where the rows have gone, and are not sent.

    Documents are dealt out by ranges of doc_id. Each range also gets the first document of the range
    below it (the lowest range: of the highest), so a window within the range sees every successor. Rows
    with equal doc_id follow each other in the order of `columns`; null doc_ids come last."""
    spark = docs.sparkSession
    n = 4 * tasks(spark)
    ids = docs.select("doc_id")
    cuts = bounds(ids, "doc_id", n)
    heads = ids.groupBy(bucket("doc_id", cuts).alias("b")).agg(F.max("doc_id").alias("top")).orderBy("b").collect()
    if not heads:
        none = docs.select("doc_id", *columns).withColumns(more)
        return none.select("*", *[F.col(c).alias(f"next_{c}") for c in [*columns, *more]])
    above = {h.b: heads[(i + 1) % len(heads)].b for i, h in enumerate(heads)}  # the range that sees this one's head
    tops = [h.top for h in heads if h.top is not None]
    rows = docs.select("doc_id", *columns).withColumn("b", bucket("doc_id", cuts))
    head = rows.where(F.col("doc_id").isin(tops)) if tops else rows
    if any(h.top is None for h in heads):
        head = head.unionAll(rows.where(F.col("doc_id").isNull()))
    moved = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    ghosts = head.withColumn("b", F.element_at(moved, F.col("b")))
    both = rows.withColumn("ghost", F.lit(0)).unionAll(ghosts.withColumn("ghost", F.lit(1)))
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), *columns)
    here = both.repartition(n, "b").withColumns(more)
    led = here.select("doc_id", "ghost", *columns, *more, *[F.lead(c).over(order).alias(f"next_{c}") for c in [*columns, *more]])
    return led.where("ghost = 0").drop("ghost")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its half-edited text's and against the next document's.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, differing,
    differing_next): near is shared digests over all digests, 1 for two texts without any; differing holds how
    the digests were recovered, and these. Null texts count as empty; an empty text has no cells. The edited text has its
    last floor(n/2) code points replaced by as many of the next text's first, or all it has. A lone
    document is its own next. Repeated rows stay and follow each other; an empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pair = with_next(texts, ["text"], {"own": F.expr(sketch_of(digests_of("text")))})
    kept = "CAST(floor(length(text) / 2) AS int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {kept}), substring(next_text, 1, {kept}))")
    made = pair.select("doc_id", F.expr("CAST(length(text) AS bigint)").alias("n_chars"), "own", F.col("next_own").alias("next"), edited.alias("edited"))
    made = made.withColumn("edit", F.expr(sketch_of(digests_of("edited"))))
    made = difference(difference(made, "own", "edit", "differing"), "own", "next", "differing_next")

    def near(other: str, differing: str) -> Column:
        size = lambda x: f"aggregate({x}.cells, 0L, (a, x) -> a + x.n) div 3"
        both = f"({size('own')} + {size(other)})"
        return F.expr(f"CASE WHEN {both} = 0 THEN 1D ELSE ({both} - size({differing}.found)) / ({both} + size({differing}.found)) END")

    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(printed("own")).alias("fingerprint"),
        F.expr(printed("edit")).alias("edited_fingerprint"),
        near("edit", "differing").alias("near_edited"),
        near("next", "differing_next").alias("near_next"),
        "differing",
        "differing_next",
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents")).drop("differing", "differing_next")
