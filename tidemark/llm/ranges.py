"""Ranges of ids that hold about as many rows each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 rising values that cut a long column into ranges; reads that column alone."""
    if parts < 2:
        return []
    cuts = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(cuts or []))


def bucket(column: str, cuts: list[int]) -> Column:
    """How many of the cuts are at or below the value, found in two steps; null values are in range 0."""
    if not cuts:
        return F.lit(0)
    w = math.isqrt(len(cuts)) + 1
    rows = [cuts[i : i + w] for i in range(0, len(cuts), w)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    chunks = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    count = lambda array: F.size(F.filter(array, lambda x: x <= F.col(column)))
    row = count(heads)
    return F.when(row > 0, (row - 1) * w + count(F.element_at(chunks, F.greatest(row, F.lit(1))))).otherwise(0)
