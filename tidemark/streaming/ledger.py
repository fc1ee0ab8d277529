"""The balance ledger as a stream: each coin's newest snapshots are state, and each new one is compared on arrival."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: snapshots that a coin's ledger keeps.
KEPT = 30
SNAPSHOT = "coin string, fetched_at string, balances map<string, double>"
DELTA = "coin string, fetched_at string, label string, balance double, previous_at string, previous double, delta double"
Delta = Row(*(field.split()[0] for field in DELTA.split(", ")))
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rounded(x: float) -> float:
    """Half away from zero at four digits, as `functions.numbers.rnd` rounds."""
    scaled = abs(x) * 10_000
    whole = int(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10_000 * (1 if x >= 0 else -1)


def compared(held: dict[str, dict[str, float]], at: str, balances: dict[str, float]) -> Iterator[tuple]:
    """(fetched_at, label, balance, previous_at, previous, delta) of a snapshot against the latest earlier one in `held` that shares a label."""
    shared = [t for t, known in held.items() if t < at and balances.keys() & known.keys()]
    previous_at = max(shared, default=None)
    before = held[previous_at] if shared else {}
    for label, balance in sorted(balances.items()):
        previous = before.get(label)
        known = balance is not None and previous is not None
        yield at, label, balance, previous_at, previous, rounded(balance - previous) if known else None


class Ledger(StatefulProcessor):
    """State of a coin: balances by label of its KEPT newest snapshots. A snapshot of a time that is held replaces it."""

    def __init__(self, kept: int = KEPT):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.snapshots = handle.getMapState("snapshots", "fetched_at string", "balances map<string, double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: dict(v[0]) for k, v in self.snapshots.iterator()} if self.snapshots.exists() else {}
        for row in sorted((r for r in rows if r.fetched_at is not None), key=lambda r: r.fetched_at):
            balances = dict(row.balances or {})
            for found in compared(held, row.fetched_at, balances):
                yield Delta(key[0], *found)
            held[row.fetched_at] = balances
            self.snapshots.updateValue((row.fetched_at,), (balances,))
            for old in sorted(held)[: -self.kept]:
                del held[old]
                self.snapshots.removeKey((old,))

    def close(self) -> None:
        pass


def ledger_deltas(snapshots: DataFrame, kept: int = KEPT) -> DataFrame:
    """(coin, fetched_at, label, balance, previous_at, previous, delta) of a stream of snapshots (coin, fetched_at, balances).

    A snapshot is one row with all its balances by label. It is compared, when it arrives, with the latest earlier one that
    shares a label, of the `kept` newest that its coin has; within a micro-batch in order of time. Snapshots without a
    time are left out; one that shares no label, or is older than all that are kept, has null previous."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    return snapshots.groupBy("coin").transformWithState(
        statefulProcessor=Ledger(kept), outputStructType=DELTA, outputMode="append", timeMode="none"
    )


def run_ledger(spark: SparkSession, source: str, out: str, checkpoint: str, kept: int = KEPT, files: int = 1000) -> None:
    """Compares what snapshot files `source` has that were not read before, appends to `out` as Parquet, and stops.

    At most `files` of them are one micro-batch; a coin's snapshots of a micro-batch are sorted in one task."""
    snapshots = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", files).parquet(source)
    query = ledger_deltas(snapshots, kept).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        started = query.outputMode("append").trigger(availableNow=True).start(out)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    started.awaitTermination()
