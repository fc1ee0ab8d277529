"""Token ids as Parquet list columns, in ascending document order over the files.

Ids repeat within a vocabulary, so they are dictionary encoded; doc_id, start and n_tokens rise or stay
near each other, so they are delta encoded (Parquet format 2). Row groups are of a set size and pages of
a set number of rows, with page indexes: a reader of some documents, or of the metadata columns alone,
skips other pages and columns."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .ranges import bounds, bucket
from .staging import in_batches, new_path, tasks
from .tables import read

FORMAT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


def _encoded(batches, path: str, end_id: int):
    encode, end, start = tokens.encoder(path).ids, np.array([end_id], dtype="<u4").tobytes(), 0
    for batch in batches:
        for i in range(0, batch.num_rows, tokens.ROWS):
            part = batch.slice(i, tokens.ROWS)
            ids = [encode(t.as_py()) + end for t in part.column(2)]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), flat)
            columns = [part.column(0), part.column(1), pa.array(start + ends - sizes), pa.array(sizes), lists]
            start += int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])


def write_tokens(docs: DataFrame, out: str, end_id: int = 0, path: str | None = None) -> None:
    """Writes (shard, doc_id, shard_start, n_tokens, ids) to `out`, a file a shard, shards by ranges of doc_id.

    Part files in the order of their names hold ascending doc_ids. shard_start counts the ids before a
    document in its shard. Each document's ids end in `end_id`; null texts count as empty and have it alone;
    null doc_ids come first; repeated rows stay, next to each other; other columns are not written."""
    n = tasks(docs.sparkSession)
    cuts = bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", n)
    narrow = docs.select(bucket("doc_id", cuts).alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = narrow.repartitionById(n, F.col("shard")).sortWithinPartitions("doc_id", "text")
    encoded = in_batches(dealt, partial(_encoded, path=path or tokens.default_path(), end_id=end_id), SCHEMA)
    encoded.write.options(**FORMAT).parquet(out)


def read_tokens(spark: SparkSession, out: str, columns: list[str] | None = None, ids: tuple | None = None) -> DataFrame:
    """The files' columns (all but the tokens cost no token reads) and documents (`ids`: lowest and highest doc_id)."""
    df = spark.read.schema(SCHEMA).parquet(out)
    if ids:
        df = df.where(F.col("doc_id").between(*ids))
    return df.select(*(columns or df.columns))


def shard_bases(spark: SparkSession, out: str) -> DataFrame:
    """(shard, base): ids in all shards before each; reads two metadata columns, one row a shard is summed."""
    sizes = read_tokens(spark, out, ["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _digests(batches):
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(crc, pa.int64())], names=[*batch.schema.names[:-1], "ids_crc32"]
        )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    write_tokens(read(spark, sf_dir, "documents"), out)
    rows = in_batches(
        read_tokens(spark, out),
        _digests, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long",
    )
    placed = rows.join(shard_bases(spark, out), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
