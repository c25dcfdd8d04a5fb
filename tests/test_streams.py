"""Streams: interrupted ingestion, running lists by key, tracks in bounded memory."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import geometry
from pulseloom.plans.pipelines import running_results
from pulseloom.streaming import ingest as ing, running

SCHEMA = "signal_type STRING, snr DOUBLE"


def put(folder, video, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{video}.csv").write_text("signal_type,snr\n" + "".join(f"{s},{v}\n" for s, v in rows))


def test_stopped_ingestion_goes_on_where_it_stopped(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    for k in range(10):
        put(source / f"set{k % 2}" / "mask", f"v{k}", [("POS", k), ("R", k + 0.5)])
    seen = []

    def stop(number):
        seen.append(number)
        if len(seen) == 3:
            raise RuntimeError("stopped after the data of a batch")

    with pytest.raises(Exception, match="stopped after the data"):
        ing.ingest(spark, str(source), SCHEMA, target, checkpoint, files_per_batch=2, after_write=stop)
    half = ing.ingested(spark, target)
    assert half.count() == 8 and half.select("batch").distinct().count() == 2  # the third batch's data isn't named
    ing.ingest(spark, str(source), SCHEMA, target, checkpoint, files_per_batch=2, after_write=seen.append)
    assert seen == [0, 1, 2, 2, 3, 4]
    whole = lambda: sorted((r["subfolder"], r["roi_type"], r["video_name"], r["signal_type"], r["snr"]) for r in ing.ingested(spark, target).collect())
    want = sorted((f"set{k % 2}", "mask", f"v{k}", s, float(v)) for k in range(10) for s, v in (("POS", k), ("R", k + 0.5)))
    assert whole() == want
    ing.ingest(spark, str(source), SCHEMA, target, checkpoint, files_per_batch=2)
    assert whole() == want
    put(source / "set2" / "mask", "late", [("POS", 77)])
    ing.ingest(spark, str(source), SCHEMA, target, checkpoint, files_per_batch=2)
    assert whole() == sorted([*want, ("set2", "mask", "late", "POS", 77.0)])


@pytest.mark.parametrize("cuts", [(60,), (20, 40, 60), (7, 8, 30, 45, 60)])
def test_running_lists_equal_the_batch(spark, tmp_path, cuts):
    rng = np.random.default_rng(4)
    rows = [(int(k) % 2, "face" if k % 3 else "nose", int(k) // 20, int(k) % 20, float(rng.normal()), 100 + int(k)) for k in range(60)]
    order = sorted(range(60), key=lambda k: k + int(rng.integers(0, 5)))  # late within the delay
    rows = [rows[k] for k in order] + [(9, "end", 0, 0, 0.0, 10_000), (9, "end", 0, 1, 0.0, 20_000)]
    schema = "video_id long, region string, run_id long, segment_id int, snr double, second int"
    timed = lambda df: df.select("*", F.timestamp_seconds("second").alias("ts")).drop("second")
    for n, (lo, hi) in enumerate([*zip((0, *cuts), cuts), (60, 61), (61, 62)]):
        timed(spark.createDataFrame(rows[lo:hi], schema)).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    stream = spark.readStream.schema(timed(spark.createDataFrame(rows[:1], schema)).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    with running.rocksdb(spark):
        query = running.stream_running(stream, "10 seconds").writeStream.format("memory").queryName(f"running{len(cuts)}").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    got = {tuple(r)[:5]: (r["snr"], r["mean_snr"]) for r in spark.table(f"running{len(cuts)}").where("region <> 'end'").collect()}
    batch = running_results(spark.createDataFrame(rows[:60], schema), ["video_id", "region"]).collect()
    assert {(r["video_id"], r["region"], r["run_id"], r["segment_id"], r["so_far"]) for r in batch} == set(got)
    for key in {(v, g) for v, g, *_ in got}:
        own = [got[k] for k in sorted(k for k in got if k[:2] == key)]
        assert [m for _, m in own] == pytest.approx(np.cumsum([s for s, _ in own]) / np.arange(1, len(own) + 1))


def tracks(points, limit):
    known, out = [], []
    for p in points:
        if None in p:
            out.append(None)
            continue
        far = [(p[0] - a) ** 2 + (p[1] - b) ** 2 for a, b in known]
        best = min(range(len(far)), key=far.__getitem__) if far else -1
        if best < 0 or far[best] >= limit:
            best = len(known)
            known.append(p)
        known[best] = p
        out.append(best)
    return out


def test_tracks_over_many_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(v, f, 0, float(rng.integers(0, 100)), float(rng.integers(0, 100)) if rng.random() > 0.02 else None) for v in (1, 2, None) for f in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = geometry.track_faces(spark.createDataFrame(rows, "video long, frame int, n int, x double, y double").repartition(5), ["video"], "frame", "n", "x", "y", 400.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2100
    for v in (1, 2, None):
        own = sorted((r for r in got if r["video"] == v), key=lambda r: r["frame"])
        assert [r["track_id"] for r in own] == tracks([(r["x"], r["y"]) for r in own], 400.0)


def test_a_long_video_takes_the_memory_of_a_batch():
    import tracemalloc

    def batches(n):
        for k in range(n):
            x = (np.arange(1000) * 37 + k % 4) % 500
            yield pa.RecordBatch.from_arrays([pa.array([1] * 1000), pa.array(x.astype(float)), pa.array((x * 7 % 500).astype(float))], names=["v", "x", "y"])

    def peak(n):
        tracemalloc.start()
        for _ in geometry.fold_tracks(batches(n), ["v"], "x", "y", 400.0):
            pass
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    peak(8)
    assert peak(40) < 1.3 * peak(8)


def test_keys_share_state(spark, tmp_path):
    """900 keys of which few rows wait: state holds buckets, not keys, and the result is the batch's."""
    schema = "video_id long, region string, run_id long, segment_id int, snr double, second int"
    rows = [(v, g, 0, k, float(v % 7 + k), 100 + 3 * k) for v in range(300) for g in ("a", "b", "c") for k in range(4)]
    timed = lambda df: df.select("*", F.timestamp_seconds("second").alias("ts")).drop("second")
    for n, part in enumerate((rows[::2], rows[1::2], [(-1, "end", 0, 0, 0.0, 9_000)])):
        timed(spark.createDataFrame(part, schema)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(timed(spark.createDataFrame(rows[:1], schema)).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    with running.rocksdb(spark):
        query = running.stream_running(stream, "1 minute").writeStream.format("memory").queryName("shared_state").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
        query.processAllAvailable()
    # the most state rows that a batch left: lists, sums and timers of a bucket
    kept = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    query.stop()
    assert 0 < kept <= 2 * 256
    got = spark.table("shared_state").where("region <> 'end'").collect()
    own = {(r["video_id"], r["region"], r["segment_id"]): (r["so_far"], r["mean_snr"]) for r in got}
    assert len(got) == len(own) == len(rows)
    assert own == {(v, g, k): (k, v % 7 + k / 2) for v, g, _, k, *_ in rows}


def test_taken_keeps_and_drops_totals():
    held = running._unpacked([], running.WAITING)
    frame = lambda rows: held.__class__(rows, columns=held.columns).astype({"video_id": int, "run_id": int, "segment_id": int, "stamp": int, "snr": float})
    none = running._unpacked([], running.TOTALS)
    made, rest, totals = running.taken(frame([(1, "a", 0, 1, 20, 3.0), (1, "a", 0, 0, 10, 1.0), (2, "a", 0, 0, 10, 5.0), (1, "a", 0, 2, 99, 8.0)]), none, 50, 1000)
    assert made[["video_id", "segment_id", "so_far", "mean_snr"]].values.tolist() == [[1, 0, 0, 1], [1, 1, 1, 2], [2, 0, 0, 5]]
    assert rest["stamp"].tolist() == [99] and sorted(totals["taken"]) == [1, 2]
    totals = running._unpacked([running._packed(totals, running.TOTALS)], running.TOTALS)
    made, rest, totals = running.taken(rest, totals, 98, 60)  # 2 is idle, 1 has an output that waits
    assert len(made) == 0 and totals["video_id"].tolist() == [1]
    made, rest, totals = running.taken(rest, totals, 500, 60)
    assert made[["so_far", "mean_snr"]].values.tolist() == [[2, 4]] and len(rest) == 0 and totals["taken"].tolist() == [3]
    made, rest, totals = running.taken(rest, totals, 501, 60)
    assert len(made) == len(totals) == 0
