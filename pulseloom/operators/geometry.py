"""Regions of pixels, boxes, and assignment of faces to tracks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def in_convex_polygon(points: DataFrame, polygons: DataFrame, on: Sequence[str], x: str = "x", y: str = "y", corners: str = "corners") -> DataFrame:
    """Pixels inside or on a convex polygon (array of x, y structs in either direction): half-plane tests, no dense masks."""
    rows = points.join(polygons, list(on))
    side = f"transform(sequence(0, size({corners}) - 1), i -> ({corners}[(i + 1) % size({corners})].x - {corners}[i].x) * ({y} - {corners}[i].y) - ({corners}[(i + 1) % size({corners})].y - {corners}[i].y) * ({x} - {corners}[i].x))"
    return rows.withColumn("_s", F.expr(side)).where(F.forall("_s", lambda v: v >= 0) | F.forall("_s", lambda v: v <= 0)).drop("_s", corners)


def convex_corners(points: DataFrame, key: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Hull corners of each key's few landmarks, in order around their centre of mass: (key, corners)."""
    from pulseloom.operators.cluster import convex_hull

    name = "_".join(key)
    keyed = points.withColumn("_k", F.to_json(F.struct(*key)))
    hull = convex_hull(keyed, "_k", x, y).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("h"))
    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in key)
    return hull.select(F.from_json("_k", types).alias(name), F.transform("h", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("corners")).select(f"{name}.*", "corners")


def region_union(pixels: DataFrame, parts: dict[str, Sequence[str]], region: str = "region") -> DataFrame:
    """Pixels of composed regions: each name's parts together, every pixel once."""
    names = F.create_map(*[F.lit(v) for name, own in parts.items() for v in (name, ",".join(own))])
    each = pixels.withColumn("_n", F.explode(F.map_keys(F.map_filter(names, lambda k, v: F.array_contains(F.split(v, ","), F.col(region))))))
    return each.withColumn(region, F.col("_n")).drop("_n").distinct()


def face_box(x: str, y: str, w: str, h: str, width: str, height: str, padding: float = 0.3) -> Column:
    """Relative box to pixels: truncated, padded by a share of its longer side, clipped to the picture."""
    px, py, pw, ph = (F.floor(F.col(c) * F.col(s)).cast("int") for c, s in ((x, width), (y, height), (w, width), (h, height)))
    pad = F.floor(padding * F.greatest(pw, ph)).cast("int")
    x0, y0, w0, h0 = px - pad, py - pad, pw + 2 * pad, ph + 2 * pad
    w1, h1 = w0 + F.least(x0, F.lit(0)), h0 + F.least(y0, F.lit(0))
    x1, y1 = F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0))
    return F.struct(x1.alias("x"), y1.alias("y"), F.least(w1, F.col(width) - x1).alias("w"), F.least(h1, F.col(height) - y1).alias("h"))


def background_box(frames: DataFrame, size: int = 128, margin: int = 10) -> DataFrame:
    """``frames(width, height, fx, fy, fw, fh)`` with (bx, by): the first place, row by row from the margin, where a square doesn't meet the face box; null if none.

    A place left of, right of, above or below the face is found by arithmetic instead of a scan.
    """
    far_x, far_y = F.col("width") - margin - size, F.col("height") - margin - size
    face_right, face_bottom = F.col("fx") + F.col("fw"), F.col("fy") + F.col("fh")
    free_at = lambda y: (F.lit(y) if isinstance(y, int) else y)
    crosses = lambda y: (free_at(y) < face_bottom) & (free_at(y) + size > F.col("fy"))
    first_x = F.when(~crosses(margin) | (F.lit(margin + size) <= F.col("fx")) | (F.lit(margin) >= face_right), F.lit(margin)).when(face_right <= far_x, face_right)
    here = F.when(first_x <= far_x, F.struct(first_x.alias("bx"), F.lit(margin).alias("by")))
    below = F.when((face_bottom <= far_y) & (F.lit(margin) <= far_x), F.struct(F.lit(margin).alias("bx"), face_bottom.alias("by")))
    return frames.withColumn("_b", F.when(F.lit(margin) <= far_y, F.coalesce(here, below))).select(*frames.columns, F.col("_b.bx").alias("bx"), F.col("_b.by").alias("by"))


def complete_landmarks(found: str, required: Sequence[int]) -> Column:
    """Whether all required indices are among those found."""
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(int(i)) for i in required]), found)) == 0, F.lit(False))


def nearest_face(faces: DataFrame, key: Sequence[str], x: str, y: str, last_x: str, last_y: str, order: str) -> DataFrame:
    """Of each key's faces the one nearest to the last point; ties go to the first in order."""
    far = (F.col(x) - F.col(last_x)) ** 2 + (F.col(y) - F.col(last_y)) ** 2
    rest = F.struct(*[F.col(c) for c in faces.columns if c not in key])
    return faces.groupBy(*key).agg(F.min_by(rest, F.struct(far, F.col(order))).alias("_r")).select(*key, "_r.*")


def fold_tracks(batches: Iterator[pa.RecordBatch], key: Sequence[str], x: str, y: str, limit: float) -> Iterator[pa.RecordBatch]:
    """Batches in order of key and time with track_id: only the present key's last places are kept from one batch to the next."""
    present: tuple | None = None
    known, count = np.empty((16, 2)), 0
    for batch in batches:
        keys = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key]))
        places = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y)], 1)
        ids: list[int | None] = []
        for own, p in zip(keys, places):
            if own != present:
                present, count = own, 0
            if np.isnan(p).any():
                ids.append(None)
                continue
            far = ((known[:count] - p) ** 2).sum(1)
            best = int(far.argmin()) if count else -1
            if best < 0 or not far[best] < limit:
                if count == len(known):
                    known = np.concatenate([known, np.empty_like(known)])
                best, count = count, count + 1
            known[best] = p
            ids.append(best)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32())], names=[*batch.schema.names, "track_id"])


def track_faces(faces: DataFrame, key: Sequence[str], frame: str, order: str, x: str, y: str, limit: float = 20000.0) -> DataFrame:
    """Faces with track_id: the nearest known track within a squared distance (first wins), else a new one.

    Tracks depend on all earlier frames, so a key's faces are folded in order by one task. They come sorted (the sort may spill) and
    go through batch by batch: a long video takes the memory of one batch and of its tracks. A face without a place has no track
    and leaves the others alone.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in faces.schema) + ", track_id int"
    ordered = faces.repartition(*key).sortWithinPartitions(*key, frame, order)
    return ordered.mapInArrow(lambda batches: fold_tracks(batches, key, x, y, limit), fields)
