"""Bulk candles from landed pages, as a data source of Spark's: one partition a symbol, each walking its pages backwards.

A page is what a provider answered to a request for the candles up to some end: a JSON array of at most `limit` positional
candles in rising order of open time. Pages lie as text below `path/symbol=.../end=...`, which is how Spark writes them
partitioned by symbol and end (milliseconds). A walk starts at the newest page, goes on with the one asked for up to the
first open time less one, and ends at an empty page, a short one, one that is not there, or once it has `last` candles."""

from __future__ import annotations

import json
import sys
from urllib.parse import quote, unquote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, open_time_ms long, open double, high double, low double, close double, volume double"
#: Candles of a page, candles kept of a symbol, and the least that are enough.
LIMIT, LAST, LEAST = 1000, 1826, 365


class TooFewCandles(ValueError):
    """A symbol whose pages hold fewer candles than are enough."""


class Symbol(InputPartition):
    def __init__(self, name: str):
        self.name = name


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def candles(page: list) -> list[tuple]:
    """(open time, open, high, low, close, volume) of a page's well-formed candles; what is no number is null."""
    found = []
    for row in page:
        if isinstance(row, list) and row and str(row[0]).lstrip("-").isdigit():
            found.append((int(row[0]), *[_number(row[k]) if k < len(row) else None for k in range(1, 6)]))
    return found


def walk(ends: list[int], read, limit: int, last: int, repeats: str) -> list[tuple]:
    """Candles of the pages that a walk from the newest of `ends` visits, by open time, the last `last` of them.

    read(end) gives a page. An end that was not landed is skipped to the next older one, so a gap between pages is no
    end. Of equal open times the candle read first stays, or the one read last with repeats = "last"."""
    held: dict[int, tuple] = {}
    ends, wanted, taken = sorted(ends, reverse=True), None, 0
    for end in ends:
        if taken >= last:
            break
        if wanted is not None and end > wanted:
            continue
        page = read(end)
        rows = candles(page) if isinstance(page, list) else []
        if not rows:
            break
        for row in rows:
            if repeats == "last" or row[0] not in held:
                held[row[0]] = row
        taken += len(page)
        wanted = rows[0][0] - 1
        if len(page) < limit:
            break
    return [held[at] for at in sorted(held)][-last:]


class KlinePages(DataSource):
    """format("kline_pages"), with options path, limit, last, least and repeats."""

    @classmethod
    def name(cls) -> str:
        return "kline_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return KlineReader(self.options)


class KlineReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.limit, self.last, self.least = (int(options.get(k, v)) for k, v in (("limit", LIMIT), ("last", LAST), ("least", LEAST)))
        self.repeats = options.get("repeats", "first")

    def _folders(self, below: str, key: str) -> dict[str, str]:
        """Values of the partition column `key` to their folders."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{below}".rstrip("/"), allow_not_found=True))
        names = [x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{key}=")]
        return {unquote(n.removeprefix(f"{key}=")): n for n in names}

    def _page(self, folder: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        files = store.get_file_info(fs.FileSelector(f"{root}/{folder}"))
        texts = [store.open_input_file(x.path).read().decode() for x in files if x.type == fs.FileType.File and x.base_name.startswith("part-")]
        try:
            return [row for text in texts for row in json.loads(text)]
        except (ValueError, TypeError):
            return None

    def partitions(self):
        return [Symbol(name) for name in sorted(self._folders("", "symbol"))]

    def read(self, partition):
        symbol = self._folders("", "symbol")[partition.name]
        ends = {int(k): v for k, v in self._folders(symbol, "end").items() if k.lstrip("-").isdigit()}
        rows = walk(list(ends), lambda end: self._page(f"{symbol}/{ends[end]}"), self.limit, self.last, self.repeats)
        if len(rows) < self.least:
            raise TooFewCandles(f"{partition.name}: {len(rows)} candles, {self.least} are needed")
        for row in rows:
            yield (partition.name, *row)


def bulk_klines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Candles (symbol, open_time_ms, open, high, low, close, volume) of landed pages, the last `last` of each symbol.

    A symbol with fewer than `least` is an error. A page that is no JSON array counts as empty. `path` is read by tasks
    through Arrow's file systems (local, HDFS, S3, GCS)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    spark.dataSource.register(KlinePages)
    uri = path if ":/" in path else f"file://{quote(path)}"
    return spark.read.format("kline_pages").options(path=uri, **options).load()


def land_pages(bars: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes bars (symbol, open_time_ms, open, high, low, close, volume) as the pages that a backward download would leave."""
    late = F.expr("row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) - 1")
    rows = bars.withColumn("page", F.floor(late / limit))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("open_time_ms", "open", "high", "low", "close", "volume"))), lambda k: F.array(*[k[c].cast("string") for c in ("open_time_ms", "open", "high", "low", "close", "volume")])))
    pages = rows.groupBy("symbol", "page").agg(body.alias("value"), F.min("open_time_ms").alias("first"), F.max("open_time_ms").alias("end"))
    asked = F.expr("coalesce(lag(first) OVER (PARTITION BY symbol ORDER BY page) - 1, end)")
    pages.withColumn("end", asked).select("symbol", "end", "value").write.partitionBy("symbol", "end").text(path)
