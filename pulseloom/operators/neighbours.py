"""Exact nearest neighbours in Euclidean space without comparing all pairs.

A bounded sample of each group becomes its pivots, and every row belongs to its nearest pivot's cell. From each cell's size, radius and
least distances to the pivot follows, by the triangle inequality, how far the k-th neighbour of any row of the cell can be, and with it
how near to its own pivot a row of another cell may be and still not matter. Rows go only to the cells that they may
matter to. Neighbouring cells share a block of a bounded number of rows and large ones are split, so a row is sent at most once to a block and
to a tile of what its own block meets: where nothing can be ruled out this is a blocked comparison of all pairs, whose shuffle is some two dozen times the
rows, not one copy a cell. Within a task each cell still meets only the rows that matter to it. Which pivots are drawn decides how much is compared,
never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pulseloom.session import scratch

#: Room for the rounding of distances: bounds are loosened by this share of the numbers they are made of.
SLACK = 1e-9
#: How many rows meet how many others at a time within a task, and how many pairs' differences are held at a time.
ROWS, OTHERS, PAIRS = 128, 4096, 100_000
#: Rows that are placed or sent at a time, blocks that a group is cut into while they are of ``tile`` rows or more, and how many times ``tile`` a block may hold.
SENT, BLOCKS, LARGEST = 512, 12, 16


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, SENT at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SENT):
            yield batch.slice(at, SENT)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product: good to rounding in the size of the vectors."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances (rows of x, rows of y) of differences, a few rows at a time."""
    step = max(1, 4_000_000 // max(1, y.size))
    return np.concatenate([np.sqrt(((x[k : k + step, None] - y[None]) ** 2).sum(-1)) for k in range(0, len(x), step)]) if len(x) else np.empty((0, len(y)))


def nearest_of(x: np.ndarray, names: np.ndarray, y: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, distance) of each row's k nearest others but itself; ties go to the smaller name. A product picks who comes into question, differences decide.

    A few rows meet a few others at a time; the k-th of the first others bounds what the rest is searched for.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = (y**2).sum(1)
    bent = np.concatenate([y, size[:, None]], 1).T  # |y|^2 - 2 x y is one product
    wide = max(OTHERS, k + 1)
    for at in range(0, len(x), ROWS):
        own, label = x[at : at + ROWS], names[at : at + ROWS]
        probe = np.concatenate([-2 * own, np.ones((len(own), 1))], 1)
        room = 1e-12 * ((own**2).sum(1) + size.max())[:, None]
        edge, parts = np.full((len(own), 1), np.inf), []
        for first in range(0, len(y), wide):
            far = probe @ bent[:, first : first + wide]
            if not first and far.shape[1] > k:  # k others and perhaps the row itself
                edge = np.partition(far, k, 1)[:, k : k + 1] + room
            row, col = np.nonzero(far <= edge)
            parts.append((row, col + first))
        row, col = (np.concatenate(v) for v in zip(*parts))
        apart = label[row] != others[col]
        row, col = row[apart], col[apart]
        distance = np.concatenate([np.empty(0), *[np.sqrt(((own[row[i : i + PAIRS]] - y[col[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(row), PAIRS)]])
        order = np.lexsort((others[col], distance, row))
        row, col, distance = row[order], col[order], distance[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[keep] + at, col[keep], distance[keep]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


class Cells:
    """What the cells of one group say about which rows may be near which."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, least: list[np.ndarray], k: int):
        self.counts, self.radius = counts, radius
        apart = exact_distances(pivots, pivots)
        room = SLACK * (apart.max(initial=0) + radius.max(initial=0))
        tails, owner = np.concatenate(least), np.repeat(np.arange(len(pivots)), [len(v) for v in least])
        # the k+1 nearest, the row itself among them, lie at most this far
        reach = np.sort(radius[:, None] + apart[:, owner] + tails[None], 1)[:, min(k, len(tails) - 1)] if len(tails) else np.zeros(len(pivots))
        #: A row of cell j may matter to cell i if its distance to its pivot is at least floor[i, j].
        self.floor = apart - radius[:, None] - reach[:, None] - room
        self.floor[:, counts == 0] = np.inf
        self.apart = apart

    def pack(self, tile: int) -> None:
        """Cells to blocks of about ``tile`` rows, near ones together, and what each block meets, cut into tiles."""
        counts, n = self.counts, len(self.counts)
        tile = min(max(tile, -(-int(counts.sum()) // BLOCKS)), LARGEST * tile)
        #: A row of cell c belongs to one of blocks first[c], ..., first[c] + parts[c] - 1.
        self.first, self.parts = np.zeros(n, np.int64), np.ones(n, np.int64)
        members: list[list[int]] = []
        free, at, held = counts > 0, int(np.argmax(counts > 0)), tile
        while free.any():
            free[at] = False
            if counts[at] > tile:
                self.first[at], self.parts[at] = len(members), -(-int(counts[at]) // tile)
                members += [[at]] * int(self.parts[at])
                held = tile
            else:
                if held + counts[at] > tile:
                    members.append([])
                    held = 0
                self.first[at] = len(members) - 1
                members[-1].append(at)
                held += counts[at]
            at = int(np.where(free, self.apart[at], np.inf).argmin())
        #: A row of cell c may matter to block p if its distance to its pivot is at least need[p, c].
        self.need = np.stack([self.floor[own].min(0) for own in members])
        self.tiles = np.maximum(1, -(-((self.need <= self.radius[None]) @ counts) // tile)).astype(np.int64)


def nearest_neighbours(df: DataFrame, id_: str, vector: str, k: int, group: str | None = None, pivots: int = 1024, cell: int = 128, tile: int = 4096, seed: int = 42) -> DataFrame:
    """(group, id, place from 1, neighbour, distance): each row's k nearest rows of its group, all of them if there are fewer.

    ``id_`` is a long that is unique within a group; ties go to the smaller one. Groups are few (classes). Rows whose vector is null, empty or incomplete, or whose
    group or id is null, neither have nor are neighbours; all vectors of a group have one length.
    """
    spark = df.sparkSession
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where((F.size("x") > 0) & whole & F.col("g").isNotNull() & F.col("id").isNotNull())
    kind, arrow = rows.schema["g"].dataType.simpleString(), to_arrow_type(rows.schema["g"].dataType)
    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}  # one row a group
    if not sizes:
        return spark.createDataFrame([], f"g {kind}, id long, place int, neighbour long, distance double")
    share = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col("g") == F.lit(g), min(1.0, 1.5 * min(pivots, -(-n // cell)) / n)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**30)) < share * 2**30).limit(4 * pivots * len(sizes)).collect()  # a bounded sample
    held = {g: np.array([r["x"] for r in drawn if r["g"] == g][: 2 * pivots]) for g in sizes}
    for g in [g for g in sizes if not len(held[g])]:
        held[g] = np.array([rows.where(F.col("g") == F.lit(g)).first()["x"]])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = np.array(batch.column(0).to_pylist(), object)
            for g in dict.fromkeys(names.tolist()):
                at = np.flatnonzero(names == g)
                part = batch.take(pa.array(at))
                x = matrix(part.column(2))
                chosen = squared(x, held[g]).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chosen.astype(np.int32)), pa.array(np.sqrt(((x - held[g][chosen]) ** 2).sum(1)))], names=["g", "id", "x", "cell", "far"])

    path = scratch(spark, "cells")
    rows.mapInArrow(assign, f"g {kind}, id long, x array<double>, cell int, far double").write.parquet(path)
    placed = spark.read.parquet(path)

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple, tuple[int, float, np.ndarray]] = {}
        for batch in batches:
            far, places = batch.column(2).to_numpy(), {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                n, top, least = own.get(key, (0, 0.0, np.empty(0)))
                own[key] = n + len(at), max(top, far[at].max()), np.sort(np.concatenate([least, far[at]]))[: k + 1]
        names, values = list(own), list(own.values())
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in names], arrow), pa.array([c for _, c in names], pa.int32()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.float64()), pa.array([v[2] for v in values], pa.list_(pa.float64()))], names=["g", "cell", "n", "top", "least"])

    counted = placed.select("g", "cell", "far").mapInArrow(census, f"g {kind}, cell int, n long, top double, least array<double>")
    counted = counted.groupBy("g", "cell").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least")).collect()  # one row a cell
    cells = {}
    for g, points in held.items():
        own = {r["cell"]: r for r in counted if r["g"] == g}
        every = range(len(points))
        cells[g] = Cells(points, np.array([own[c]["n"] if c in own else 0 for c in every]), np.array([own[c]["top"] if c in own else 0.0 for c in every]), [np.array(own[c]["least"]) if c in own else np.empty(0) for c in every], k)

        cells[g].pack(tile)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its own block's tiles as one that asks, and to a tile of every block that it may matter to."""
        for batch in slices(batches):
            names, far = np.array(batch.column(0).to_pylist(), object), batch.column(4).to_numpy()
            ids, at = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for g in dict.fromkeys(names.tolist()):
                own, rows_ = cells[g], np.flatnonzero(names == g)
                c, h = at[rows_], mixed[rows_]
                block = own.first[c] + h % own.parts[c]
                times = own.tiles[block]
                asks = np.repeat(rows_, times)
                turn = np.arange(len(asks)) - np.repeat(np.cumsum(times) - times, times)
                matters, to = np.nonzero(own.need[:, c].T <= far[rows_][:, None])
                row = np.concatenate([asks, rows_[matters]])
                unit, part = np.concatenate([np.repeat(block, times), to]), np.concatenate([turn, h[matters] // 7 % own.tiles[to]])
                side = np.repeat(np.array([0, 1], np.int8), [len(asks), len(to)])
                sent = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([sent.column(0), pa.array(unit.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(side), *sent.columns[1:]], names=["g", "block", "part", "side", "id", "x", "cell", "far"])

    def compare(unit: pa.Table) -> pa.Table:
        side, g = unit.column("side").to_numpy(), unit.column("g")[0].as_py()
        ask, met = unit.filter(pa.array(side == 0)), unit.filter(pa.array(side == 1))
        names, others, floor = ask.column("id").to_numpy(), met.column("id").to_numpy(), cells[g].floor
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ask) and len(met):
            x, y = (np.concatenate([matrix(c) for c in t.column("x").chunks]) for t in (ask, met))
            at, where, far, whole = ask.column("cell").to_numpy(), met.column("cell").to_numpy(), met.column("far").to_numpy(), []
            for c in np.unique(at):
                own, near = np.flatnonzero(at == c), np.flatnonzero(floor[c, where] <= far)
                if len(near) > 0.5 * len(met):  # hardly anything is ruled out: such cells meet all together
                    whole.append(own)
                elif len(near):
                    row, col, distance = nearest_of(x[own], names[own], y[near], others[near], k)
                    found.append((own[row], near[col], distance))
            if whole:
                own = np.concatenate(whole)
                row, col, distance = nearest_of(x[own], names[own], y, others, k)
                found.append((own[row], col, distance))
        row, col, distance = (np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
        near = pa.StructArray.from_arrays([pa.array(distance, pa.float64()), pa.array(others[col], pa.int64())], ["distance", "neighbour"])
        return pa.table({"g": pa.array([g] * len(starts), arrow), "id": pa.array(names[row[starts]], pa.int64()), "near": pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), near)})

    units = placed.mapInArrow(spread, f"g {kind}, block int, part int, side byte, id long, x array<double>, cell int, far double")
    found = units.groupBy("g", "block", "part").applyInArrow(lambda t: compare(t), f"g {kind}, id long, near array<struct<distance:double,neighbour:long>>")
    best = found.groupBy("g", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("s"))  # k a tile
    return best.select("g", "id", F.posexplode("s").alias("place", "s")).select("g", "id", (F.col("place") + 1).alias("place"), "s.neighbour", "s.distance")
