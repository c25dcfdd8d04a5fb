"""Mini-batch k-means against the full one; results written in one pass."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import cluster
from pulseloom.sources import files


def test_minibatches_come_near_full_kmeans(spark):
    rng = np.random.default_rng(0)
    at = rng.normal(size=(5, 2)) * 20
    rows = [(k, *(at[k % 5] + rng.normal(size=2)).tolist()) for k in range(4000)] + [(9000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    _, _, full = cluster.kmeans(df, ["a", "b"], 5)
    found, centres, inertia = cluster.minibatch_kmeans(df, ["a", "b"], 5, "id", batch=300, steps=12)
    assert inertia <= 1.05 * full and found.count() == 4000 and len(centres) == 5
    for c in centres:
        assert np.abs(at - c).sum(1).min() < 1


def test_one_step_is_the_running_mean(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (10.0, 0.0)], "a double, b double")
    centres, weights = cluster.minibatch_step(df, ["a", "b"], [[1.0, 0.0], [9.0, 0.0], [99.0, 0.0]], [2.0, 0.0, 4.0])
    assert centres == [[1.0, 0.0], [10.0, 0.0], [99.0, 0.0]] and weights == [4.0, 1.0, 4.0]


def results(spark, n):
    return spark.range(n).select(F.lit("P,OS").alias("signal_type"), (F.col("id") * 1.0).alias("heart_rate"), (F.col("id") * 7 % 100 * 1.0).alias("snr"), F.lit("None").alias("wavelet"), F.lit(1).alias("wavelet_level"), F.lit("f").alias("filter"), F.lit(2).alias("filter_order"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("region"), F.lit(-1).alias("patch_idx"))


def test_results_of_all_regions_in_one_job(spark, tmp_path):
    folder = str(tmp_path / "out")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None) or [])
    files.save_results(results(spark, 300), folder, parts=2)
    assert len(tracker.getJobIdsForGroup(None) or []) - before <= 2  # the shuffle's and the write's, however many regions
    assert sorted(os.listdir(folder)) == ["r0", "r1", "r2"] and all(len(os.listdir(f"{folder}/{r}/results")) == 2 for r in ("r0", "r1", "r2"))
    back = files.scan_csv(spark, folder, files.RESULT_SCHEMA).collect()
    assert sorted(r["heart_rate"] for r in back) == list(map(float, range(300))) and {r["signal_type"] for r in back} == {"P,OS"}
    with open(f"{folder}/r1/results/part-0.csv") as f:
        snr = [float(line.split(",")[-7]) for line in f.read().splitlines()[1:]]
    assert snr == sorted(snr, reverse=True)
    broken = results(spark, 300).withColumn("heart_rate", F.when(F.col("heart_rate") == 299, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("heart_rate")))
    with pytest.raises(Exception, match="stop"):
        files.save_results(broken, folder)
    assert len(files.scan_csv(spark, folder, files.RESULT_SCHEMA).collect()) == 300 and os.listdir(folder + "-staged") == []
    with pytest.raises(TypeError):
        files.save_results(results(spark, 3).withColumn("snr", F.lit("x")), folder)
