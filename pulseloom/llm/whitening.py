"""Whitening of embeddings by their principal components, from a covariance taken in two passes.

Components become integers. The first pass adds them up exactly (``exact_sums``), so the mean is a quotient of integers. The
second centres every vector by n * x - S, still exact, and adds the outer products of a batch by one matrix product; tasks' matrices are
merged by ``treeAggregate``. The driver decomposes the matrix, of the size of the dimension and not of the table, and broadcasts the
projection. A third pass measures what the projection does to the covariance, and the last one applies it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.exact_sums import LIMBS, complete, limb_batch, merged, rows_of

MATRICES = pa.schema([("size", pa.int64()), ("matrix", pa.binary())])


def _integers(values: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(values * scale).astype(np.int64) + shift


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they suffice, Python's otherwise."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0))
    if largest < 2**61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(off: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null beyond a long."""
    if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * max(off.shape[1], 1) < 2**63:
        return (off * off).sum(1).tolist()
    each = (off.astype(object) ** 2).sum(1).tolist()
    return [int(d) if d < 2**63 else None for d in each]


def _matrices(kept: DataFrame, product: Callable[[np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """For each length the sum over all batches of a square matrix made of a batch's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, values in rows_of(batch.column(1)):
                size, found = values.shape[1], product(values)
                if found is not None:
                    own[size] = own[size] + found if size in own else found
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([m.tobytes() for m in own.values()], pa.binary())], schema=MATRICES)

    def add(total: dict[int, np.ndarray], more: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        for size, matrix in more.items():
            total[size] = total[size] + matrix if size in total else matrix
        return total

    def row(total: dict[int, np.ndarray], r) -> dict[int, np.ndarray]:
        flat = np.frombuffer(r["matrix"], np.float64)
        return add(total, {r["size"]: flat.reshape(int(np.sqrt(len(flat))), -1)})

    return kept.mapInArrow(run, "size long, matrix binary").rdd.treeAggregate({}, row, add, depth=2)


def principal(covariance: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, whether each is more than rounding) of the largest ones, falling."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    real = values > len(covariance) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    return values, vectors, real


def whiten(vectors: DataFrame, top: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``vectors(vec_id, embedding)`` to one row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped, and those with an entry whose integer isn't one that a double
    holds exactly (beyond 2^52). Entry c is floor(scale * c) + shift. Vectors of another length have a fit of their own; empty vectors have no components. Repeated rows
    count each; other columns are passed over; an empty table gives no rows. A component without variance (fewer distinct vectors than components) has
    null as whitened and takes no part in identity_error; without any variance explained and identity_error are null. A deviation beyond a long is null.
    """
    spark = vectors.sparkSession
    kept = vectors.where(complete("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.forall("embedding", lambda c: F.abs(c) * scale < 2.0**52) & (F.size("embedding") > 0))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, values in rows_of(batch.column(1)):
                x, size = _integers(values, scale, shift), values.shape[1]
                safe = x if int(np.abs(x).max()) * len(x) < 2**62 else x.astype(object)
                for at, total in enumerate([*safe.sum(0).tolist(), len(x)]):
                    sums[size, at] = sums.get((size, at), 0) + total
        yield limb_batch(sums)

    found = merged(kept.mapInArrow(add_up, LIMBS))  # as many rows as a vector has components
    sizes = sorted({size for size, _ in found})
    fits = {size: (found[size, size], np.array([found[size, at] for at in range(size)], object)) for size in sizes}

    def outer(values: np.ndarray) -> np.ndarray:
        n, sums = fits[values.shape[1]]
        y = centred(_integers(values, scale, shift), n, sums).astype(np.float64) / n
        return y.T @ y

    model = {}
    for size, total in _matrices(kept, outer).items():
        covariance = total / fits[size][0]
        values, axes, real = principal(covariance, top)
        spread = np.trace(covariance)
        model[size] = axes / np.sqrt(np.where(real, values, np.nan)), values / spread if spread > 0 else np.full(len(values), np.nan), real
    shared = spark.sparkContext.broadcast(model)  # of the dimension's size

    def project(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, sums = fits[values.shape[1]]
        off = centred(_integers(values, scale, shift), n, sums)
        return off, (off.astype(np.float64) / n) @ shared.value[values.shape[1]][0]

    def square(values: np.ndarray) -> np.ndarray:
        _, w = project(values)
        return w.T @ w

    errors: dict[int, float | None] = {}
    for size, total in _matrices(kept, square).items():
        real = model[size][2]
        off = (total / fits[size][0] - np.eye(len(total)))[np.ix_(real, real)]
        errors[size] = float(np.abs(off).max()) if off.size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in rows_of(batch.column(1)):
                off, w = project(values)
                size, (rows, parts) = values.shape[1], w.shape
                each = lambda a: np.repeat(np.asarray(a), parts)
                number = lambda a: pa.array(a, pa.float64(), from_pandas=True)  # noqa: E731  NaN as null
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each(at))), pa.array(np.tile(np.arange(1, parts + 1), rows), pa.int32()), pa.array(np.full(rows * parts, fits[size][0], np.int64)), pa.array([d for d in deviations(off) for _ in range(parts)], pa.int64()), number(w.ravel()), number(np.tile(shared.value[size][1], rows)), pa.array([errors[size]] * (rows * parts), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
