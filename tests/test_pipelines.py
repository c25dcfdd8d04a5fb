import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulseloom.operators import balance, trials
from pulseloom.plans import pipelines
from pulseloom.sources import files


def colours(n=260, gap=135):
    t = np.arange(n)
    beat = np.sin(2 * np.pi * 1.4 * t / 30)
    rng = np.random.default_rng(1)
    return pd.DataFrame({"video_id": 1, "region": "cheeks", "patch_idx": -1, "frame_idx": t, "valid": t != gap, "r": 120 + beat + rng.normal(0, 0.2, n), "g": 90 - 2 * beat + rng.normal(0, 0.2, n), "b": 70 + 0.5 * beat + rng.normal(0, 0.2, n)})


def test_frames_to_signals(spark):
    df = spark.createDataFrame(colours())
    got = pipelines.extract_pulse(df, 30.0, method="fft_bandpass").collect()
    assert {r["signal_type"] for r in got} == {"R", "G", "B", "RG", "RB", "GB", "RGB", "POS", "APOS", "2SR"}
    assert {(r["run_id"], r["segment_id"]) for r in got} == {(0, 0)}
    assert all(len(r["filtered"]) == 128 for r in got)
    assert abs(next(r["heart_rate"] for r in got if r["signal_type"] == "POS") - 84) < 8
    assert pipelines.extract_pulse(df, 30.0, done=df).collect() == []
    other = pipelines.extract_pulse(df, 30.0, opponent=True, method="bandpass").collect()
    assert {r["signal_type"] for r in other} == {"oRG", "oYB", "oRGYB", "aT", "o2SR"}


def test_results_to_rankings(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame({"signal_type": rng.choice(["POS", "R"], n), "heart_rate": rng.normal(80, 10, n), "snr": rng.normal(2, 1, n), "wavelet": "None", "filter": rng.choice(["a", "b", "c"], n), "subfolder": rng.choice(["x", "y"], n)})
    pdf.loc[pdf["filter"] == "c", "snr"] += 3 * rng.normal(size=(pdf["filter"] == "c").sum())
    df = spark.createDataFrame(pdf)
    best = pipelines.rank_results(df, [["filter"], ["signal_type", "filter"]], 2, f"{tmp_path}/out")
    assert best.count() == 4 and best.where("grouping = 'filter' AND category = 'c'").count() == 0
    assert files.scan_csv(spark, f"{tmp_path}/out", "category STRING, snr_score DOUBLE, mean DOUBLE, std DOUBLE, mad DOUBLE, hr_score DOUBLE, combined_mean DOUBLE, combined_std DOUBLE, combined_mad DOUBLE, hr_in_range_proportion DOUBLE, snr_above_threshold_proportion DOUBLE, combined_in_range_proportion DOUBLE, combined_score DOUBLE", "part*.csv").count() == 4
    tests = pipelines.compare_best(df, ["filter"], 3)
    assert set(tests) == {"snr", "heart_rate"} and tests["snr"]["test_used"] in ("ANOVA", "Kruskal-Wallis")
    points = pipelines.quantile_points(df, "snr").toPandas()
    assert np.corrcoef(points["value"], points["expected"])[0, 1] > 0.9


def test_signals_to_classifier(spark):
    rng = np.random.default_rng(3)
    make = lambda k, n, first: spark.createDataFrame([(first + i, (rng.normal(size=8) + k).tolist()) for i in range(n)] + [(first + n, [float("nan")] * 8)], "sample_id long, features array<double>")
    rows = pipelines.training_data(make(0.0, 150, 0), make(1.0, 60, 1000), "features", "sample_id")
    counts = {(r["split"], r["label"]): r["count"] for r in rows.groupBy("split", "label").count().collect()}
    assert counts["train", 0] == counts["train", 1] == 36 and counts["val", 0] == 30 and counts["test", 1] == 12
    _, table = pipelines.fit_trial(rows, "features", {"regParam": 0.01, "maxIter": 30})
    assert {r["split"]: r["accuracy"] > 0.75 for r in table.collect()} == {"train": True, "val": True, "test": True}
    ranked = pipelines.study(spark, rows, "features", {"regParam": (1e-4, 1.0, "log"), "elasticNetParam": (0.0, 1.0, "linear")}, n=3).orderBy("place").collect()
    assert [r["place"] for r in ranked] == [1, 2, 3] and ranked[0]["value"] >= ranked[2]["value"]
    over = pipelines.training_data(make(0.0, 50, 0), make(1.0, 20, 1000), "features", "sample_id", "oversample")
    assert over.where("split = 'train'").groupBy("label").count().select(F.countDistinct("count")).first()[0] == 1


def test_pruned_study_finds_the_full_runs_winner(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 2, (rng.normal(size=6) + (k % 2) * np.array([1.2, 0, 0, 0.8, 0, 0])).tolist()) for k in range(300)]
    data = balance.split(spark.createDataFrame(rows, "id long, label int, x array<double>"), ["label"], "id")
    space = {"regParam": (1e-3, 30.0, "log"), "elasticNetParam": [0.0, 1.0]}
    full = {}
    for t in trials.suggest(spark, space, 9, 42).collect():
        full[t["trial_id"]] = pipelines.fit_trial(data, "x", {k: t[k] for k in space} | {"maxIter": 45})[1].where("split = 'val'").first()["accuracy"]
    got = {r["trial_id"]: r for r in pipelines.halving(spark, data, "x", space, metric="accuracy").collect()}
    assert len(got) == 9 and sorted(r["place"] for r in got.values()) == list(range(1, 10))
    best = next(k for k, r in got.items() if r["place"] == 1)
    assert full[best] == max(full.values())
    assert sum(r["epochs"] for r in got.values()) < 0.5 * 9 * 45 and sum(r["pruned"] for r in got.values()) == 8
    assert got[best]["rung"] == 2 and got[best]["epochs"] == 5 + 15 + 45
    broken = pipelines.halving(spark, data, "x", {"regParam": [-1.0]}, n=2).collect()
    assert [r["value"] for r in broken] == [None, None]
