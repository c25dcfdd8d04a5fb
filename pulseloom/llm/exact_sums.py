"""Sums of integers of any size over a table: exact, and merged by Spark.

A task adds with Python's integers and sends each sum as limbs of 40 bits with its sign. Spark adds limbs of one
place as longs (a million tasks fit), so nothing is rounded and nothing overflows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 40
LIMBS = "part long, at int, limb int, value long"
LIMB_SCHEMA = pa.schema([("part", pa.int64()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def complete(vector: str) -> Column:
    """Whether a vector is there and has neither nulls nor NaN nor infinities."""
    return F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length among complete vectors."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(size))


def limb_batch(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Sums by (part, at) as rows of limbs; zeros have one row too."""
    rows: list[tuple[int, int, int, int]] = []
    for (part, at), total in sums.items():
        sign, left, limb = (-1 if total < 0 else 1), abs(int(total)), 0
        while left or not limb:
            rows.append((part, at, limb, sign * (left & (1 << BITS) - 1)))
            left >>= BITS
            limb += 1
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LIMB_SCHEMA)], schema=LIMB_SCHEMA)


def merged(limbs: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of all tasks. The driver gets a row for each (part, at) and limb: callers bound their number."""
    found: dict[tuple[int, int], int] = {}
    for r in limbs.groupBy("part", "at", "limb").agg(F.sum("value").alias("value")).collect():
        found[r["part"], r["at"]] = found.get((r["part"], r["at"]), 0) + (r["value"] << BITS * r["limb"])
    return found
