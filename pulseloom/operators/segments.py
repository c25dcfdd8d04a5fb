"""Frames to gap-free runs and overlapping segments, and window algebra over time.

Segment membership is arithmetic (a frame knows its segments from its place in the
run), so there is no range join. Windows share one partitioning and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def runs(frames: DataFrame, key: Sequence[str], order: Sequence[str], valid: str = "valid") -> DataFrame:
    """Valid frames with run_id (invalid frames before them), place in the run from 0, and the run's length. An invalid or unknown frame ends a run."""
    time = Window.partitionBy(*key).orderBy(*order)
    bad = F.when(F.coalesce(F.col(valid), F.lit(False)), 0).otherwise(1)
    marked = frames.withColumn("run_id", F.sum(bad).over(time.rowsBetween(Window.unboundedPreceding, 0))).where(F.coalesce(F.col(valid), F.lit(False)))
    own = Window.partitionBy(*key, "run_id")
    return marked.withColumn("place", F.row_number().over(own.orderBy(*order)) - 1).withColumn("run_length", F.count("*").over(own))


def segments(frames: DataFrame, key: Sequence[str], order: Sequence[str], valid: str = "valid", size: int = 128, overlap: int = 32) -> DataFrame:
    """One row for each frame and segment that holds it: run_id, segment_id and t (0..size-1). Incomplete tails give no segment."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is less than the size")
    step = size - overlap
    placed = runs(frames, key, order, valid).where(F.col("run_length") >= size)
    first = F.greatest(F.lit(0), F.ceil((F.col("place") - size + 1) / F.lit(step))).cast("int")
    last = F.least(F.floor(F.col("place") / F.lit(step)), F.floor((F.col("run_length") - size) / F.lit(step))).cast("int")
    held = placed.where(first <= last).withColumn("segment_id", F.explode(F.sequence(first, last)))
    return held.withColumn("t", F.col("place") - F.col("segment_id") * step).drop("place", "run_length")


def pack_segments(rows: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Segments as arrays in order of t (a segment's size bounds them)."""
    packed = rows.groupBy(*key, "run_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("t", *values))).alias("s"))
    return packed.select(*key, "run_id", "segment_id", *[F.expr(f"transform(s, x -> x.`{v}`)").alias(v) for v in values])


def mask_validity(masks: DataFrame, frame: Sequence[str], region: str = "region", patch: str = "patch_idx", pixels: str = "pixels") -> DataFrame:
    """Frames with valid: every region has pixels; a region of patches fails only when all its patches are empty."""
    regions = masks.groupBy(*frame, region).agg(F.max(F.coalesce(F.col(pixels), F.lit(0))).alias("_p"))
    return regions.groupBy(*frame).agg(F.min("_p").alias("_p")).select(*frame, (F.col("_p") > 0).alias("valid"))


def window_length(fps: float, seconds: float = 1.6) -> int:
    return int(seconds * fps)


def sliding_normalised(rows: DataFrame, key: Sequence[str], order: str, value: str, length: int) -> DataFrame:
    """Value normalised by the window that ends at each row: null before the first full window; a constant window divides by one."""
    time = Window.partitionBy(*key).orderBy(order)
    back = time.rowsBetween(-(length - 1), 0)
    sd = F.stddev_pop(value).over(back)
    full = F.row_number().over(time) >= length
    return rows.withColumn("normalised", F.when(full, (F.col(value) - F.avg(value).over(back)) / F.when(sd == 0, 1.0).otherwise(sd)))


def overlap_add(rows: DataFrame, key: Sequence[str], order: str, value: str, length: int, name: str = "total") -> DataFrame:
    """Sum over all windows that cover a row, of a value given at each window's last row."""
    return rows.withColumn(name, F.coalesce(F.sum(value).over(Window.partitionBy(*key).orderBy(order).rowsBetween(0, length - 1)), F.lit(0.0)))


def differences(rows: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """First differences; null at each key's first row."""
    return rows.withColumn("difference", F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(order)))


def unwrap(rows: DataFrame, key: Sequence[str], order: str, angle: str) -> DataFrame:
    """Angles without jumps of more than half a turn."""
    time = Window.partitionBy(*key).orderBy(order)
    step = F.col(angle) - F.lag(angle).over(time)
    turn = F.coalesce(-2 * F.pi() * F.round(step / (2 * F.pi())), F.lit(0.0))
    return rows.withColumn("_turn", turn).withColumn("unwrapped", F.col(angle) + F.sum("_turn").over(time.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def interval_rates(peaks: DataFrame, key: Sequence[str], place: str, fps: float) -> DataFrame:
    """Beats a minute from the mean interval of each key's peaks; 0 with fewer than two."""
    found = peaks.groupBy(*key).agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(place).alias("n"))
    return found.select(*key, F.when(F.col("n") > 1, 60 * fps * (F.col("n") - 1) / (F.col("b") - F.col("a"))).otherwise(F.lit(0.0)).alias("heart_rate"))
