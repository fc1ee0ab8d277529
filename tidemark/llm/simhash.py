"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits
have a segment that differs in at most one, so they share that segment as it is or with the one bit
wildcarded. Each fingerprint is indexed under 2 x (1 + 32) such variants, equal variants meet in one
equality shuffle, and each meeting pair is verified on all 64 bits. Any further difference than three is
never linked, and no pair within three is lost."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .simhash_kernel import SKETCH, crossing, fingerprint_batches, jaccard_batches, set_batches, signature_batches, sketch_batches
from .staging import by_ids, in_batches, release, stage, tasks
from .tables import read

SEGMENT_BITS = 32
#: Fingerprints of one variant that are compared at a time; a larger group goes through in such blocks.
BLOCK = 1024
#: Members of a band up to which each two are compared at once; of a larger one, members that a task compares with as many others.
FEW, MEMBERS = 8, 1024
#: Bytes of sketches in a block of a crowded band, about.
BLOCK_BYTES = 1 << 20


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): the 64-bit SimHash of each whole text over `width`-word shingles, as a signed long.

    Null and empty texts, and texts of white space, have fingerprint 0. Repeated rows stay."""
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return in_batches(narrow, partial(fingerprint_batches, width=width), f"{id_col} long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(slot, part, fp): each distinct fingerprint under its two whole segments and their 32 one-wildcard variants.

    slot is 33 x segment + wildcarded bit, or + 32 for the whole segment; part is the segment without that bit."""
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("slot"))
    segment = F.when(F.col("slot") < 33, F.expr("fp & 4294967295L")).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    mask = F.expr("CASE WHEN slot % 33 = 32 THEN -1L ELSE ~shiftleft(1L, slot % 33) END")
    return rows.select(F.col("slot").cast("int"), segment.bitwiseAND(mask).alias("part"), "fp")


def _forest(fp: np.ndarray, slot: int, radius: int):
    """Links that span what fingerprints of one variant make up at `radius`: at most one less than members.

    Block against block, so memory is bounded by BLOCK squared. A wildcard variant only links
    fingerprints that differ in its bit; those that agree there meet in the whole segment's group."""
    bit = None if slot % 33 == 32 else np.uint64(slot % 33 + 32 * (slot // 33))
    label = np.arange(len(fp))
    for i in range(0, len(fp), BLOCK):
        for j in range(i, len(fp), BLOCK):
            x = fp[i : i + BLOCK, None] ^ fp[None, j : j + BLOCK]
            near = np.bitwise_count(x) <= radius
            if bit is not None:
                near &= ((x >> bit) & np.uint64(1)).astype(bool)
            for p in np.flatnonzero(near.any(axis=1)):
                to = j + np.flatnonzero(near[p])
                others, first = np.unique(label[to], return_index=True)
                own = label[i + p]
                for other, k in zip(others, first):
                    if other != own:
                        label[label == other] = own
                        yield fp[i + p], fp[to[k]]


def _linked(batches, radius: int, limit: int | None):
    """Rows (slot, ..., fp), sorted by all but fp, to rows (slot, part, fp) of two kinds.

    slot -1: a verified link between part and fp. Else: a row of a group of more than `limit` rows, passed on
    unread for a finer split. Memory: a batch, and a group that runs over batches up to `limit`."""
    held = passing = None

    def rows(slot, part, fp):
        return pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int32()), pa.array(part, pa.int64()), pa.array(fp.view(np.int64), pa.int64())],
            names=["slot", "part", "fp"],
        )

    def groups(columns):
        *key, fp = columns
        fp = fp.view(np.uint64)
        if not len(fp):
            return
        cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        begins, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
        size, slot = ends - begins, key[0]
        p = begins[size == 2]
        s, x = slot[p], fp[p] ^ fp[p + (len(fp) > 1)]
        at = (s % 33 + 32 * (s // 33)).astype(np.uint64) % np.uint64(64)
        near = (np.bitwise_count(x) <= radius) & ((s % 33 == 32) | (((x >> at) & np.uint64(1)) == 1))
        a, b = [fp[p[near]]], [fp[p[near] + 1]]
        for lo, hi in zip(begins[size > 2], ends[size > 2]):
            if limit and hi - lo > limit:
                yield rows(slot[lo:hi], key[1][lo:hi], fp[lo:hi])
            elif found := list(_forest(fp[lo:hi], int(slot[lo]), radius)):
                u, v = zip(*found)
                a.append(np.array(u, np.uint64)), b.append(np.array(v, np.uint64))
        a, b = np.concatenate(a), np.concatenate(b)
        yield rows(np.full(len(a), -1), a.view(np.int64), b)

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if not batch.num_rows:
            continue
        if passing is not None:  # the batch before ended in a group that is passed on
            other = np.flatnonzero(np.any([c != k for c, k in zip(columns, passing)], axis=0))
            n = other[0] if len(other) else batch.num_rows
            yield rows(columns[0][:n], columns[1][:n], columns[-1][:n])
            columns = [c[n:] for c in columns]
            if not len(columns[0]):
                continue
            passing = None
        if held is not None:
            columns = [np.concatenate((h, c)) for h, c in zip(held, columns)]
        other = np.flatnonzero(np.any([c != c[-1] for c in columns[:-1]], axis=0))
        keep = other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
        yield from groups([c[:keep] for c in columns])
        held = [c[keep:] for c in columns]
        if limit and len(held[0]) > limit:
            passing = [c[-1] for c in columns[:-1]]
            yield rows(held[0], held[1], held[-1])
            held = None
    if held is not None:
        yield from groups(held)


def _finer(crowded: DataFrame, limit: int) -> DataFrame:
    """Rows of crowded variants under variants of the other segment too: its two halves of 16 bits, whole or with one wildcard.

    At most three differing bits are left there, so one half differs in at most one. Rows that then still
    meet agree in 46 bits, which bounds a group by 2^18 whatever the input. A group of more than `limit`
    rows is cut into blocks, dealt out in pairs (lo, hi), so that no task compares more than two blocks."""
    rows = crowded.select("slot", "part", "fp", F.explode(F.sequence(F.lit(0), F.lit(33))).alias("half"))
    other = F.expr("CASE WHEN slot < 33 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    bits = F.when(F.col("half") < 17, other.bitwiseAND(F.lit(65535))).otherwise(F.shiftrightunsigned(other, 16))
    mask = F.expr("CASE WHEN half % 17 = 16 THEN -1L ELSE ~shiftleft(1L, half % 17) END")
    keys = ["slot", "part", "half", "finer"]
    rows = rows.select("slot", "part", F.col("half").cast("int"), bits.bitwiseAND(mask).alias("finer"), "fp")
    large = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*keys, F.least("block", "mate").alias("lo"), F.greatest("block", "mate").alias("hi"), "fp")


def links(fps: DataFrame, radius: int = 3, limit: int = 4096) -> DataFrame:
    """(a, b): verified links between distinct fingerprints that span every component at `radius` <= 3 bits.

    fps: distinct non-null `fp`. One shuffle deals the variants out by their value; within a partition
    they are sorted, so a group is a run of rows. A variant of more than `limit` fingerprints is not
    compared in one task: its rows are dealt out again under finer variants, and of those that are still
    as large in pairs of blocks, which lose no pair either."""
    if radius > 3:
        raise ValueError("two segments with one wildcard hold all pairs up to three differing bits")

    def meet(rows: DataFrame, keys: list[str], most: int | None) -> DataFrame:
        dealt = rows.repartition(tasks(fps.sparkSession), *keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(partial(_linked, radius=radius, limit=most), "slot int, part long, fp long")

    spread = fps.repartition(tasks(fps.sparkSession))  # a row becomes 66, so no few tasks may hold many
    found = stage(meet(variants(spread), ["slot", "part"], limit), "variants")
    crowded = found.where("slot >= 0")
    out = found.where("slot < 0")
    if not crowded.isEmpty():
        out = out.unionAll(meet(_finer(crowded, limit), ["slot", "part", "half", "finer", "lo", "hi"], None))
    return out.select(F.col("part").alias("a"), F.col("fp").alias("b"))


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints reach each other by links of `radius` bits at most.

    Copies share a fingerprint and are represented by their smallest doc_id, so a group of copies costs
    one row however large it is. component_id is the smallest doc_id reachable. Null texts count as empty
    (fingerprint 0, linked like any other); rows with a null doc_id keep a null doc_id and their group's
    component_id, null if the group has no other; repeated rows stay; an empty table gives an empty result."""
    per_doc = stage(fingerprints(docs, width), "simhash")
    by_fp = per_doc.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    groups = connected_components(links(by_fp.select("fp"), radius), "a", "b")
    # components are named by fingerprints; the smallest doc_id of each names it from here on
    named = by_fp.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return per_doc.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _across(members: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """(a, b): pairs of one band and two components that sketches do not rule out at `similarity`.

    members: (band, key, n, id, component, size, sketch). A band goes through in pairs of blocks of about
    MEMBERS texts or BLOCK_BYTES of sketches, a task's rows whatever its size. nearest: of each text only the closest of every other component."""
    size = F.ceil(F.sum(F.greatest(F.lit(SKETCH), F.lit(2) * F.col("size"))) / 8 / BLOCK_BYTES)
    blocks = F.greatest(F.ceil(F.first("n") / MEMBERS), size).cast("int").alias("blocks")
    dealt = members.groupBy("band", "key").agg(blocks)
    rows = members.join(dealt, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows = rows.select("band", "key", "lo", "hi", "block", "id", "component", "size", "sketch")

    def compare(block: pa.Table) -> pa.Table:
        return crossing(block, similarity, nearest)

    return rows.groupBy("band", "key", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicate_components(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents joined by links of word-shingle Jaccard similarity at or above `similarity`.

    At similarity 0.8 of five-word shingles two 64-bit SimHashes differ in 9 bits as a median (4 to 15), so
    three bits alone would find one pair in thirty. Candidates therefore come from the deletion variants of
    the fingerprints and from bands of minima over the same shingle hashes; every candidate is verified on
    the whole shingle sets. Texts with equal words are one row. Up to FEW members of a band meet each other;
    those of a larger one meet two of its members first. What then is one component needs no more pairs, so a
    group of copies costs its own size; members of a larger band in different components are all held against
    each other, block against block, and every pair that sketches of their sets do not rule out is verified.

    Texts without words are copies of each other. Null doc_ids are left out, an empty table gives no rows,
    and repeated rows come once."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sign = partial(signature_batches, width=width)
    signed = stage(in_batches(docs, sign, "doc_id long, digest binary, fp long, bands array<long>"), "signatures")
    reps = stage(signed.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")

    members = reps.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(members.join(sizes, ["band", "key"]), "bands")
    few = shared.where(F.col("n") <= FEW).select("band", "key", "id")
    met = few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), ["band", "key"]).where("a > b").select("a", "b")
    # in a crowded band: all against the member that shares most bands with others, as an original does with
    # its copies, and against one of the band's own choice
    crowd = shared.where(F.col("n") > FEW)
    central = crowd.join(crowd.groupBy("id").agg(F.sum("n").alias("p")), "id")
    heads = central.groupBy("band", "key").agg(
        F.max(F.struct("p", "id")).alias("x"), F.max(F.struct(F.xxhash64("id", "band"), "id")).alias("y")
    )
    heads = heads.select("band", "key", F.array_distinct(F.array("x.id", "y.id")).alias("heads"))
    met = met.unionAll(crowd.join(heads, ["band", "key"]).select(F.col("id").alias("a"), F.explode("heads").alias("b")))

    one = reps.groupBy("fp").agg(F.min("id").alias("id"))
    same_fp = reps.join(one.withColumnRenamed("id", "b"), "fp").select(F.col("id").alias("a"), "b")
    close = links(one.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    close = close.join(one.withColumnsRenamed({"fp": "x", "id": "a"}), "x")
    close = close.join(one.withColumnsRenamed({"fp": "y", "id": "b"}), "y").select("a", "b")

    def alike(met: DataFrame, label: str) -> DataFrame:
        """Candidates that are similar enough, by their whole shingle sets."""
        pairs = met.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        pairs = stage(pairs.distinct(), f"candidates-{label}")
        needed = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"needed-{label}")
        texts = in_batches(by_ids(docs, needed, "left_semi"), partial(set_batches, width=width), "id long, shingles binary")
        sets = stage(texts.dropDuplicates(["id"]), f"shingles-{label}")
        both = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "of_a"}), "a")
        both = both.join(sets.withColumnsRenamed({"id": "b", "shingles": "of_b"}), "b").select("a", "b", "of_a", "of_b")
        found = in_batches(both, jaccard_batches, "a long, b long, similarity double").where(F.col("similarity") >= similarity)
        found = stage(found.select("a", "b"), f"alike-{label}")
        release(pairs, needed, sets)
        return found

    first = alike(met.unionAll(same_fp).unionAll(close), "first")
    groups = connected_components(first, "a", "b").withColumnRenamed("node", "id")
    groups = stage(reps.select("id").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "groups")

    # members of crowded bands that are in different components by now: first each with the nearest of every
    # other component, which merges what is left of large groups, then all pairs of components still apart
    parted = crowd.join(groups, "id").groupBy("band", "key").agg(F.min("component").alias("p"), F.max("component").alias("q"))
    parted = stage(crowd.join(parted.where("p < q").select("band", "key"), ["band", "key"]).select("band", "key", "n", "id"), "parted")
    if not parted.isEmpty():
        needed = stage(parted.select(F.col("id").alias("doc_id")).distinct(), "needed-sketches")
        texts = in_batches(by_ids(docs, needed, "left_semi"), partial(sketch_batches, width=width), "id long, size int, sketch binary")
        sketches = stage(texts.dropDuplicates(["id"]), "sketches")
        for nearest in (True, False):
            met = _across(parted.join(groups, "id").join(sketches, "id"), similarity, nearest)
            found = alike(met, "nearest" if nearest else "across")
            if found.isEmpty():
                continue
            ends = found.join(groups.withColumnsRenamed({"id": "a", "component": "x"}), "a")
            ends = ends.join(groups.withColumnsRenamed({"id": "b", "component": "y"}), "b").select("x", "y")
            merged = connected_components(ends, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("into"))
            merged = groups.join(merged, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
            groups = stage(merged, "groups")
    of_text = reps.join(groups, "id").select("digest", F.col("component").alias("component_id"))
    return signed.select("doc_id", "digest").join(of_text, "digest").select("doc_id", "component_id").distinct()


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of `docs`, as they were: of each group the one with the smallest doc_id, and rows without a doc_id.

    A doc_id of several rows keeps one of them."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    gone = stage(near_duplicate_components(docs, width, similarity).where("doc_id != component_id").select("doc_id"), "gone")
    again = stage(ids.count().where("count > 1").select("doc_id"), "again")
    rest = by_ids(docs, gone, "left_anti")
    once = by_ids(rest, again, "left_anti")
    return once.unionByName(by_ids(rest, again, "left_semi").dropDuplicates(["doc_id"]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
