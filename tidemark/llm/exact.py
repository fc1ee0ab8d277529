"""Exact duplicates by two passes of Bloom filtering, in DataFrame functions only.

The first pass counts cells: each text's hash falls into one of 64 cells a row or more, and a cell's rows are summed
before and after one shuffle of (cell, count). Cells with two rows or more are what the second filter holds: a
blocked Bloom filter, four bits of one 64-bit word a cell, its words in blocks that every task gets. A row whose bits
are not all set is alone with its text and passes straight through; only the others shuffle, by the digest of their
text. The filter is BITS a cell up to MOST_BLOCKS; past that it fills up, so more rows shuffle and none is lost.

A group of copies is summed before its shuffle. Rows of groups that hold more than a share of HOT of all rows meet
their group in a broadcast, which at most 1 / HOT groups can be in, so no key gathers its rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage
from .tables import read

#: Cells of the first filter for each row, at least; bits of the second for each cell that it holds.
CELLS, BITS = 64, 32
#: Words of 64 bits in a block of the second filter, and the most blocks that a task is sent (64 MB).
WORDS, MOST_BLOCKS = 512, 16_384
#: Share of all rows beyond which a group's rows meet it in a broadcast, and the least rows of such a group.
HOT, LEAST_HOT = 1e-5, 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str) -> Column:
    """A text with A-Z in lower case; null is empty. `lower` does the same where all is ASCII, and is faster."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _power_of_two(least: int) -> int:
    return 1 << max(0, (max(1, least) - 1).bit_length())


def possibly_repeated(keys: DataFrame, rows: int) -> DataFrame:
    """(cell) of the first filter that two rows or more of keys (h, a 64-bit hash) fall into."""
    cell = F.col("h").bitwiseAND(F.lit(_power_of_two(CELLS * rows) - 1))
    return keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")


def _mask(cell: str) -> Column:
    """Four bits of a word, some of which may be the same."""
    bits = [f"shiftleft(1L, CAST(shiftright(xxhash64({cell}, 'bits'), {6 * i}) & 63 AS int))" for i in range(4)]
    return F.expr(" | ".join(bits))


def _word(cell: str, blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64({cell}, 'word'), {blocks * WORDS}L)")


class Repeats:
    """The second filter: which rows may share their text with another one."""

    def __init__(self, cells: DataFrame, rows: int):
        """cells: a staged table of (cell); rows: of the table that the first filter was made of."""
        spark = cells.sparkSession
        self.cells = _power_of_two(CELLS * rows)
        self.blocks = min(MOST_BLOCKS, 1 + cells.count() * BITS // (64 * WORDS))
        held = cells.select(_word("cell", self.blocks).alias("word"), _mask("cell").alias("mask"))
        all_words = spark.range(self.blocks * WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        words = held.unionAll(all_words).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        at = F.struct(F.pmod("word", F.lit(WORDS)).alias("k"), "mask")
        self.table = words.groupBy(F.floor(F.col("word") / WORDS).alias("_block")).agg(
            F.array_sort(F.collect_list(at)).getField("mask").alias("_words")
        )

    def marked(self, df: DataFrame, h: str) -> DataFrame:
        """`df` with _may: false for rows whose hash `h` no other row has."""
        x = df.withColumn("_cell", F.col(h).bitwiseAND(F.lit(self.cells - 1)))
        x = x.withColumns({"_word": _word("_cell", self.blocks), "_mask": _mask("_cell")})
        x = x.withColumn("_block", F.floor(F.col("_word") / WORDS)).join(F.broadcast(self.table), "_block")
        held = F.get("_words", F.pmod("_word", F.lit(WORDS)).cast("int"))
        return x.withColumn("_may", held.bitwiseAND(F.col("_mask")) == F.col("_mask")).drop("_cell", "_word", "_mask", "_block", "_words")


def _digests(docs: DataFrame) -> DataFrame:
    """(n, doc_id, sha, h) of every row, staged: a number of the row, the digest of its normalised text and that digest's hash."""
    sha = F.unhex(F.sha2(normalised("text"), 256))
    rows = docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", sha.alias("sha"))
    return stage(rows.withColumn("h", F.xxhash64("sha")), "digests")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs (doc_id, text), repeated ones too.

    Texts are equal if they are after lower-casing A-Z alone; a null text is empty. Of equal texts the row of the largest
    doc_id stays, null ids being smallest, and of rows that repeat that doc_id one. Other columns are not read; an empty
    table gives no rows. Digests are compared by all their 256 bits."""
    rows = _digests(docs)
    total = rows.count()
    filter_ = Repeats(stage(possibly_repeated(rows, total), "repeated-cells"), total)
    marked = filter_.marked(rows, "h").drop("h")
    largest = F.max(F.struct("doc_id", "n"))
    groups = stage(
        marked.where("_may").groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), largest.alias("last")), "groups"
    )
    hot = groups.where(F.col("group_size") > max(LEAST_HOT, int(HOT * total)))
    spread = marked.where("_may").join(F.broadcast(hot), "sha")
    met = marked.where("_may").join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(groups, "sha")
    alone = marked.where(~F.col("_may")).withColumns(
        {"group_size": F.lit(1).cast("long"), "last": F.struct("doc_id", "n")}
    )
    columns = ["doc_id", "n", "sha", "group_size", "last"]
    found = spread.select(columns).unionAll(met.select(columns)).unionAll(alone.select(columns))
    return found.select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("n") == F.col("last.n")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and any other columns) without the rows that `exact_duplicates` drops.

    Rows that cannot have a copy are passed on where they are read; the others are reduced to one a text before
    they shuffle, and again after. Which of several rows of the largest doc_id stays is any."""
    sha = F.unhex(F.sha2(normalised("text"), 256))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), sha.alias("_sha"))
    keyed = keyed.withColumn("_h", F.xxhash64("_sha"))
    total = docs.count()
    marked = Repeats(stage(possibly_repeated(keyed.select(F.col("_h").alias("h")), total), "repeated-cells"), total).marked(keyed, "_h")
    # max_by passes over rows without an id, so a key that is never null stands for it
    order = F.struct(F.col("_id").isNotNull(), F.col("_id"))
    stay = marked.where("_may").groupBy("_sha").agg(F.max_by("row", order).alias("row"))
    return marked.where(~F.col("_may")).select("row").unionAll(stay.select("row")).select("row.*")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
  groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM texts JOIN groups USING (t)
"""
