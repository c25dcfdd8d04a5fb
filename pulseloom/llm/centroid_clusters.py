"""Centroid clustering of integer vectors: float32 screening with rounding-error intervals, exact where they overlap.

Each batch is multiplied with the centroids in single precision. A product of vectors of n terms, whatever the order of
its additions, is off by at most ((n + 2) u / (1 - (n + 2) u)) |x| |c| with u = 2^-24, the rounding of both inputs
included. That gives an interval for each squared distance (less the vector's own square, which is common to
all). A centroid whose interval begins above the least upper end can't be the nearest. Where more than one is left, their
distances are taken with integers, and the lowest number wins a tie. So assignments are exact, and most vectors need no
integer product. Sums for new centroids are exact too (``exact_sums``), as is the rounding down of their means.

The driver and every task hold the centroids (k vectors), no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.exact_sums import LIMBS, complete, limb_batch, merged, rows_of
from pulseloom.llm.store import stored

#: Components up to this size keep squared distances of up to 64 terms within 64 bits.
NARROW = 2**27
UNIT = 2.0**-24


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value): 64-bit integers where they are narrow, Python's otherwise."""
    if not values.size or np.abs(values).max() * scale < NARROW:
        return np.floor(values * scale).astype(np.int64)
    # doubles from 2^60 on are integers, and the product might not be finite
    exact = [int(np.floor(v * scale)) if abs(v) < 2.0**60 else int(v) * scale for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids)."""
    return ((x[:, None, :] - centroids[None]) ** 2).sum(-1)


def screen(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to each vector: True for the nearest ones always."""
    wide = x.astype(np.float64), centroids.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (wide[0].astype(np.float32) @ wide[1].astype(np.float32).T).astype(np.float64)
    terms = x.shape[1] + 2
    gamma = terms * UNIT / (1 - terms * UNIT)
    own, square = np.sqrt((wide[0] ** 2).sum(1)), (wide[1] ** 2).sum(1)
    score = square - 2 * product
    # the last part covers the double-precision steps, the squares' own rounding among them
    error = 2 * gamma * own[:, None] * np.sqrt(square) * (1 + 1e-9) + 2.0**-44 * (square + 2 * np.abs(product))
    known = np.isfinite(score) & np.isfinite(error)
    low, high = np.where(known, score - error, -np.inf), np.where(known, score + error, np.inf)
    return low <= high.min(1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance) for integer vectors; ties go to the lowest number."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
        each = distances(x, centroids)
        chosen = np.array([min(range(len(row)), key=row.__getitem__) for row in each], np.int64)
        return chosen, each[np.arange(len(x)), chosen]
    possible = screen(x, centroids)
    chosen = possible.argmax(1)
    for k in np.array_split(open_ := np.flatnonzero(possible.sum(1) > 1), len(open_) // 1024 + 1):
        if len(k):
            chosen[k] = np.where(possible[k], distances(x[k], centroids), np.iinfo(np.int64).max).argmin(1)
    return chosen, ((x - centroids[chosen]) ** 2).sum(1)


def _assigned(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """(vec_id, cluster, distance, centroid_sha256)."""
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = as_matrix(centroids)
        for batch in batches:
            for at, values in rows_of(batch.column(1)):
                chosen, far = nearest(integers(values, scale), centres)
                fits = [int(d) if d < 2**63 else None for d in far]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(chosen, pa.int32()), pa.array(fits, pa.int64()), pa.array([names[c] for c in chosen], pa.string())], names=["vec_id", "cluster", "distance", "centroid_sha256"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, centroid_sha256 string")


def _moved(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Each centroid replaced by its vectors' mean, rounded down component by component; one without vectors stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sums = as_matrix(centroids), {}
        for batch in batches:
            for _, values in rows_of(batch.column(1)):
                x = integers(values, scale)
                chosen, _ = nearest(x, centres)
                for c in np.unique(chosen).tolist():
                    own = x[chosen == c]
                    for at, total in enumerate([*own.sum(0).tolist(), len(own)]):
                        sums[c, at] = sums.get((c, at), 0) + total
        yield limb_batch(sums)

    sums = merged(kept.mapInArrow(run, LIMBS))  # k rows of as many sums as a vector has components
    size = len(centroids[0])
    return [[sums[c, at] // sums[c, size] for at in range(size)] if (c, size) in sums else own for c, own in enumerate(centroids)]


def as_matrix(centroids: list[list[int]]) -> np.ndarray:
    """Centroids as 64-bit integers if they are narrow, else as Python's."""
    narrow = max((abs(v) for c in centroids for v in c), default=0) < NARROW
    return np.array(centroids, np.int64 if narrow else object)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """``vectors(vec_id, embedding)`` to one row for each vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``size`` components, none null or non-finite; each becomes floor(scale * x). The first
    centroids are the k kept vectors with the smallest hex SHA-256 of ``<seed>:<vec_id>`` (null ids last, ties by the vector), all of
    them if there are fewer. Repeated rows count each; other columns are passed over; no kept vectors give no rows. A distance or
    inertia beyond a long is null; its assignment is exact all the same.
    """
    if not 0 < size <= 64:
        raise ValueError("size must be between 1 and 64")  # so that narrow distances fit in 64 bits
    kept = vectors.where((F.size("embedding") == size) & complete("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "embedding").limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = integers(np.array([r["embedding"] for r in first], np.float64), scale).tolist()
    for _ in range(rounds):
        centroids = _moved(kept, centroids, scale)
    found = stored(_assigned(kept, centroids, scale), "clusters")
    total = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c).cast("decimal(38,0)")))
    sums = found.groupBy("cluster").agg(total("distance").alias("own"))
    whole = found.agg(total("distance").alias("all"))
    sums = sums.join(F.broadcast(whole)).select("cluster", F.expr("try_cast(own AS long)").alias("cluster_inertia"), F.expr("try_cast(all AS long)").alias("inertia"))
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def reference_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same by brute force in DuckDB: every distance of every round with integers."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) q WHERE len(e) = {size} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT vec_id, unnest(range(1, {size + 1})) AS i, floor({scale} * unnest(e))::BIGINT AS x FROM v)",
        f"f AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id))) AS place FROM v)",
        f"c0 AS MATERIALIZED (SELECT f.place - 1 AS c, x.i, x.x FROM x JOIN f USING (vec_id) WHERE f.place <= {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT x.vec_id, c.c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{r} c USING (i) GROUP BY x.vec_id, c.c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := d, c := c)) AS b FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            floor = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
            parts.append(f"m{r} AS MATERIALIZED (SELECT c, i, {floor} AS x FROM (SELECT a.b.c AS c, x.i, sum(x.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN x USING (vec_id) GROUP BY 1, 2) q)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m ON m.c = o.c AND m.i = o.i)")
    return f"""WITH {', '.join(parts)}, h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY c)
        SELECT a.vec_id, a.b.c::INT AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.c))::BIGINT AS cluster_inertia, (sum(a.b.d) OVER ())::BIGINT AS inertia, h.s AS centroid_sha256 FROM a{rounds} a JOIN h ON h.c = a.b.c"""
