"""Best-fit packing planned on a length histogram.

Lengths are at most the capacity, so the histogram has at most that many rows however many items there
are. Best-fit in order of falling length runs on its counts and hands out runs of slots; items then take
the planned slots by joining on their rank within their length. Ranks are counted in salted groups, so a
length that a third of all items share is ranked by many tasks."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .staging import stage, tasks
from .tables import read

CAPACITY = 2048


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, items, first sequence, offset): item first rank + i goes to sequence first sequence + i.

    Same sequences as best-fit by falling length item by item: the fullest open sequence that has room
    takes as many items of a length as fit, then the next. At most about capacity x (log capacity + 2)
    rows for new sequences and the filling of open ones."""
    open_by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan, sequences = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        left, rank = counts[length], 0

        def fill(room: int, first: int, n: int, each: int) -> None:
            nonlocal rank, left
            for k in range(each):
                plan.append((length, rank, n, first, capacity - room + k * length))
                rank, left = rank + n, left - n
            leave(room - each * length, first, n)

        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
                each = room // length
                whole = min(n, left // each)
                if whole:
                    fill(room, first, whole, each)
                elif left:
                    fill(room, first, 1, left)
                    whole = 1
                leave(room, first + whole, n - whole)
            else:
                each = capacity // length
                whole = left // each
                if whole:
                    fill(capacity, sequences, whole, each)
                    sequences += whole
                if left:
                    fill(capacity, sequences, 1, left)
                    sequences += 1
    return plan


def ranked(items: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """`items` with `out`: a number from 0 within equal `key`, gapless, each given once.

    Rows are dealt into as many salted groups a key as a shuffle has tasks; a group's numbers begin where
    the groups before it end. `items` must read the same rows each time, as a staged table does."""
    salt = F.pmod(F.xxhash64(*order), F.lit(tasks(items.sparkSession))).alias("_salt")
    salted = items.select("*", salt)
    sizes = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    return (
        salted.withColumn("_within", within)
        .join(bases, [key, "_salt"])
        .withColumn(out, F.col("_base") + F.col("_within"))
        .drop("_salt", "_base", "_within")
    )


def best_fit_pack(items: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """`items` with sequence_id and offset, in as few sequences of at most `capacity` as best-fit finds.

    items: a staged table with a non-null long `length` within 1 and capacity; `order`: columns that tell
    rows apart (rows equal in all of them are interchangeable). The histogram, at most `capacity` rows, is
    all that the driver reads. An empty table gives an empty result; other columns are carried along."""
    spark: SparkSession = items.sparkSession
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}
    schema = "_length long, _rank long, _items long, _first long, _offset long"
    # bounded by the capacity, not by the items: see best_fit_plan
    plan = F.broadcast(spark.createDataFrame(best_fit_plan(counts, capacity), schema))
    numbered = ranked(items, length, order, "_place")
    slot = (F.col(length) == F.col("_length")) & F.col("_place").between(
        F.col("_rank"), F.col("_rank") + F.col("_items") - 1
    )
    return numbered.join(plan, slot).select(
        *items.columns,
        (F.col("_first") + F.col("_place") - F.col("_rank")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )


def ids_crc32(ids: str = "ids") -> Column:
    return F.crc32(ids).alias("ids_crc32")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces in packed sequences.

    A piece is the span [start, start + length) of the document's ids (with the end id), so no ids are
    shuffled; `tokens.pieces` gives the ids themselves. Null texts count as empty: the end id alone."""
    cut = tokens.pieces(docs, capacity, end_id, path)
    spans = stage(cut.select("doc_id", "piece", "start", "length", ids_crc32()), "pieces")
    return best_fit_pack(spans, ["doc_id", "piece", "start", "ids_crc32"], capacity)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
