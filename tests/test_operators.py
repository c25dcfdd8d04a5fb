import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import special
from pulseloom.functions.quantiles import exact_quantiles, nested_bins
from pulseloom.operators import balance, cluster, geometry, metrics, pulse, scoring, segments, significance, spectral, trials
from pulseloom.sources import files
from pulseloom.streaming import segmenter

NAN, INF = float("nan"), float("inf")


# --- scoring

def test_scores_against_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"category": rng.choice(["a", "b", "c"], 400), "subfolder": rng.choice(["x", "y"], 400), "snr": rng.normal(0, 5, 400), "heart_rate": rng.normal(140, 30, 400)})
    pdf.loc[len(pdf)] = ["single", "x", -3.0, 40.0]
    df = spark.createDataFrame(pdf)
    got = {r["category"]: r for r in scoring.combined_scores(df, "category").collect()}
    for name, g in pdf.groupby("category"):
        mean, sd = g.snr.mean(), g.snr.std()
        mad = (g.snr - mean).abs().mean()
        penalty = max(1 - math.log(1 + 0.001 * abs(mean)), 0.1) if mean < 0 else 1
        sub = g.groupby("subfolder").heart_rate.agg(["mean", "std", "count"])
        cm = (sub["mean"] * sub["count"]).sum() / sub["count"].sum()
        cs = math.sqrt((sub["count"] * (sub["std"] ** 2 + (sub["mean"] - cm) ** 2)).sum() / sub["count"].sum())
        spread = sub["mean"].map(lambda m: (m - sub["mean"]).abs().mean())
        cmad = (spread * sub["count"]).sum() / sub["count"].sum()
        p = max(1 - math.log(1 + 0.001 * (48 - cm)), 0.1) if cm < 48 else max(1 - math.log(1 + 0.001 * (cm - 150)), 0.1) if cm > 150 else 1
        if name == "single":
            assert got[name]["snr_score"] is None and got[name]["combined_score"] is None
            continue
        assert got[name]["snr_score"] == pytest.approx(penalty / (1 + 0.5 * sd + 0.5 * mad))
        assert got[name]["hr_score"] == pytest.approx(p / (1 + 0.5 * cs + 0.5 * cmad))
        both = (g.heart_rate.between(48, 150) & (g.snr > 0)).mean()
        assert got[name]["combined_score"] == pytest.approx(0.33 * (got[name]["snr_score"] + got[name]["hr_score"] + both))
    shuffled = scoring.combined_scores(df.orderBy(F.rand(3)), "category").collect()
    assert all(r["combined_score"] == pytest.approx(got[r["category"]]["combined_score"]) for r in shuffled if r["combined_score"] is not None)


def test_cleaning(spark):
    rows = [(1.0, 60.0, "a"), (NAN, 60.0, "a"), (INF, 60.0, "a"), (0.0, 60.0, "a"), (1.0, 0.0, "a"), (1.0, 60.0, None), (-INF, 1.0, "a")]
    assert scoring.clean_results(spark.createDataFrame(rows, "snr double, heart_rate double, c string")).count() == 1


def test_best_in_range_and_ties(spark):
    rows = [(1, 5.0, 60.0), (2, 5.0, 60.0), (3, 1000.0, 60.0), (4, 9.0, 200.0)]
    df = spark.createDataFrame(rows, "seq long, snr double, heart_rate double")
    assert scoring.best_in_range(df).first()["seq"] == 1
    assert scoring.best_in_range(df.where("seq > 2")).collect() == []
    assert [r["seq"] for r in scoring.top_n(df, "snr", 3, "seq").collect()] == [3, 4, 1]


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n), "v": np.round(rng.lognormal(0, 3, n), 2)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], list("pqrst")).collect()
    want = pdf.groupby("k").v
    assert len(got) == want.ngroups
    for r in got:
        v = want.get_group(r["k"])
        assert [r[c] for c in "pqrst"] == pytest.approx([v.quantile(p) for p in (0, 0.25, 0.5, 0.9, 1)])
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert exact_quantiles(empty, ["k"], "v", [0.5], ["m"]).collect() == []


def test_density_peak(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": rng.normal(7, 1, 3000)}))
    assert scoring.kde_peak(df, "k", "v").first()["peak"] == pytest.approx(7, abs=0.4)


# --- segments and pulse

@pytest.mark.parametrize("size, overlap", [(128, 32), (8, 2), (4, 1), (5, 0)])
def test_segments_like_a_buffer(spark, size, overlap):
    bad = {130, 300, 301}
    frames = [(1, k, k not in bad) for k in range(401)] + [(2, 5, None), (2, 6, True)]
    want, buffer, runs, number = [], [], 0, 0
    for k in range(401):
        if k in bad:
            buffer, runs, number = [], runs + 1, 0
            continue
        buffer.append(k)
        if len(buffer) == size:
            want += [(runs, number, t, f) for t, f in enumerate(buffer)]
            buffer, number = buffer[size - overlap :], number + 1
    df = spark.createDataFrame(frames, "video long, frame int, valid boolean")
    got = segments.segments(df, ["video"], ["frame"], size=size, overlap=overlap).where("video = 1").collect()
    assert sorted((r["run_id"], r["segment_id"], r["t"], r["frame"]) for r in got) == sorted(want)


def naive_pulse(x, length):
    n = len(x)
    out = {k: np.zeros(n) for k in pulse.RGB_SIGNALS}
    for e in range(length - 1, n):
        m = e - length + 1
        own = x[m : e + 1]
        sd = own.std(0)
        z = ((own - own.mean(0)) / np.where(sd == 0, 1, sd)).T
        s = np.where(z.std(1) != 0, z.std(1), 1e-8)
        mixes = {"R": z[0], "G": z[1], "B": z[2], "RG": z[0] + s[0] / s[1] * z[1], "RB": z[0] + s[0] / s[2] * z[2], "GB": z[1] + s[1] / s[2] * z[2], "RGB": z[0] + s[0] / s[1] * z[1] + s[0] / s[2] * z[2]}
        a, b = z[1] - z[2], -2 * z[0] + z[1] + z[2]
        mixes["POS"] = a - a.std() / b.std() * b
        coef = np.linalg.lstsq(np.c_[z[0], z[1], np.ones(length)], z[2], rcond=None)[0]
        normal = np.array([1, 1, coef.sum()])
        normal /= np.linalg.norm(normal)
        p = z.T @ (np.eye(3) - np.outer(normal, normal))
        mixes["APOS"] = p[:, 0] - p[:, 0].std() / p[:, 1].std() * p[:, 1]
        for k, v in mixes.items():
            out[k][m : e + 1] += v - v.mean()
    return out


def test_pulse_against_loops(spark):
    x = np.random.default_rng(2).uniform(0, 255, (128, 3))
    df = spark.createDataFrame([(1, t, *map(float, c)) for t, c in enumerate(x)], "v long, t int, cr double, cg double, cb double")
    got = pulse.pulse_signals(df, ["v"], "t", ["cr", "cg", "cb"], 48).orderBy("t").toPandas()
    for k, v in naive_pulse(x, 48).items():
        assert got[f"signal_{k}"].to_numpy() == pytest.approx(v, abs=1e-8)


def test_pulse_of_constant_and_short_series(spark):
    flat = spark.createDataFrame([(1, t, 5.0, 5.0, 5.0) for t in range(20)], "v long, t int, a double, b double, c double")
    rows = pulse.pulse_signals(flat, ["v"], "t", ["a", "b", "c"], 8).collect()
    assert all(abs(r[f"signal_{k}"]) < 1e-6 for r in rows for k in ("R", "POS", "APOS"))
    short = pulse.pulse_signals(flat.where("t < 5"), ["v"], "t", ["a", "b"], 8).collect()
    assert all(r["signal_aT"] == 0 for r in short)


def test_rotation_of_scaled_colours():
    x = np.random.default_rng(3).uniform(0, 255, (60, 3))
    y = pulse.spatial_rotation(x, 20)
    assert y.shape == (60,) and np.isfinite(y).all() and y.any()
    assert pulse.spatial_rotation(x[:, :2], 20).any() and not pulse.spatial_rotation(x[:15], 20).any()


def test_overlap_add_unwrap_and_rates(spark):
    df = spark.createDataFrame([(1, t, 1.0 if t >= 3 else None, (2.5 * t + math.pi) % (2 * math.pi) - math.pi) for t in range(10)], "v long, t int, w double, a double")
    total = [r["total"] for r in segments.overlap_add(df, ["v"], "t", "w", 4).orderBy("t").collect()]
    assert total == [1, 2, 3, 4, 4, 4, 4, 3, 2, 1]
    angles = [r["unwrapped"] for r in segments.unwrap(df, ["v"], "t", "a").orderBy("t").collect()]
    assert angles == pytest.approx(np.unwrap([r["a"] for r in df.orderBy("t").collect()]).tolist())
    peaks = spark.createDataFrame([(1, 0), (1, 30), (1, 60), (2, 4)], "k long, p int")
    assert {r["k"]: r["heart_rate"] for r in segments.interval_rates(peaks, ["k"], "p", 30).collect()} == {1: 60.0, 2: 0.0}
    assert segments.window_length(30) == 48


def test_filters_on_awkward_signals(spark):
    good = np.sin(np.arange(128)).tolist()
    rows = [(1, good), (2, None), (3, []), (4, [1.0] * 5), (5, good[:-1] + [NAN]), (6, [3.0] * 128)]
    df = spark.createDataFrame(rows, "k long, signal array<double>")
    got = {r["k"]: r for r in spectral.post_process(df, method="bandpass").collect()}
    assert [k for k, r in got.items() if r["filtered"] is not None] == [1, 6]
    back = spectral.inverse(spectral.spectrum(df, "k"), "k")
    assert {r["k"]: r["signal"] for r in back.collect()}[1] == pytest.approx(good)


# --- significance

def test_tails():
    assert special.normal_tail(1.96) == pytest.approx(0.0249979, rel=1e-5)
    assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, rel=1e-5)
    assert special.f_tail(3.0, 3, 20) == pytest.approx(0.0548, abs=2e-4)
    assert special.f_tail(4.35, 1, 20) == pytest.approx(0.05, abs=2e-4)
    assert special.normal_quantile(0.975) == pytest.approx(1.959964, rel=1e-6)
    assert special.kolmogorov_tail(0.136, 100) == pytest.approx(0.05, abs=0.01)


def test_shapiro_separates():
    rng = np.random.default_rng(0)
    assert np.mean([special.shapiro(rng.normal(size=50).tolist())[1] > 0.05 for _ in range(100)]) > 0.85
    assert special.shapiro(rng.exponential(size=100).tolist())[1] < 1e-4
    w, p = special.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])  # a published example
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01


def test_comparisons(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b", "c"], 60), "v": np.concatenate([rng.normal(m, 1, 60) for m in (0, 0, 2)])})
    r = significance.compare_groups(spark.createDataFrame(pdf), "g", "v")
    assert r["test_used"] == "ANOVA" and r["significant"] and 0.3 < r["effect_size"] < 0.9 and r["post_hoc"] is None
    pdf["v"] = np.exp(3 * pdf["v"])
    r = significance.compare_groups(spark.createDataFrame(pdf), "g", "v")
    assert r["test_used"] == "Kruskal-Wallis" and r["significant"]
    assert {(x["group_a"], x["group_b"]) for x in r["post_hoc"].collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    pairs = {(x["group_a"], x["group_b"]): x["p_adjusted"] for x in significance.dunn(spark.createDataFrame(pdf), "g", "v").collect()}
    assert pairs["a", "c"] < 0.001 and pairs["b", "c"] < 0.001 and pairs["a", "b"] > 0.05
    assert significance.compare_groups(spark.createDataFrame(pdf[pdf.g == "a"]), "g", "v")["test_used"] == "Not enough groups"
    big = significance.normality(spark.createDataFrame(pdf), "g", "v", most=50)
    assert all(x["test"] == "ks" and 0 <= x["statistic"] <= 1 for x in big.collect())


def test_an_outlier_leaves_no_crowded_bin(spark):
    rng = np.random.default_rng(3)
    values = [*rng.random(5000).tolist(), *(1.7e9 + 100 * rng.random(3000)).tolist(), *(-rng.random(500)).tolist(), 0.0, -0.0, 1e300, -1e9, 5e-324, INF, -INF]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = nested_bins(rows, [], "v", bins=64, crowd=100)
    sizes = [r["count"] for r in got.groupBy("_b").count().collect()]
    assert max(sizes) <= 150 and sum(sizes) == len(values)
    order = [r["v"] for r in got.orderBy("_b", "v").collect()]
    assert order == sorted(values)
    assert nested_bins(spark.createDataFrame([(NAN,), (INF,)], "v double"), [], "v").orderBy("_b").first()["v"] == INF
    keyed = nested_bins(rows.selectExpr("v", "CAST(v > 0.5 AS INT) AS k"), ["k"], "v", bins=64, crowd=100)
    assert max(r["count"] for r in keyed.groupBy("k", "_b").count().collect()) <= 150
    assert nested_bins(rows.limit(0), [], "v").collect() == []


def test_quantiles_and_ranks_with_an_outlier(spark, monkeypatch):
    from pulseloom.functions import quantiles

    monkeypatch.setattr(quantiles.nested_bins, "__defaults__", ("_b", 32, 20))
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, 900), [1e9, -1e7], np.repeat(0.25, 60)])
    pdf = pd.DataFrame({"g": np.arange(len(v)) % 3, "v": v})
    df = spark.createDataFrame(pdf)
    for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99], list("abc")).collect():
        np.testing.assert_allclose([r["a"], r["b"], r["c"]], np.quantile(pdf.v[pdf.g == r["g"]], [0.1, 0.5, 0.99]))
    want = pdf.v.rank()
    got = {r["value"]: r["rank"] for r in significance.ranked(df, "g", "v").collect()}
    assert all(got[x] == k for x, k in zip(pdf.v, want))


# --- inference

def test_lstm_step_by_step():
    from pulseloom.operators import inference

    rng = np.random.default_rng(1)
    w = {"w_in": rng.standard_normal((12, 2)), "w_state": rng.standard_normal((12, 3)), "bias": rng.standard_normal(12)}
    x = rng.standard_normal((2, 5, 2))
    got = inference.lstm_states(x, [w])
    sig = lambda v: 1 / (1 + math.exp(-v))
    for row in range(2):
        h, c = [0.0] * 3, [0.0] * 3
        for t in range(5):
            z = [sum(w["w_in"][g, k] * x[row, t, k] for k in range(2)) + sum(w["w_state"][g, k] * h[k] for k in range(3)) + w["bias"][g] for g in range(12)]
            c = [sig(z[3 + k]) * c[k] + sig(z[k]) * math.tanh(z[6 + k]) for k in range(3)]
            h = [sig(z[9 + k]) * math.tanh(c[k]) for k in range(3)]
            np.testing.assert_allclose(got[row, t], h)


def test_encoder_and_classifier(spark):
    from pulseloom.operators import inference

    rng = np.random.default_rng(2)
    d = lambda *s: rng.standard_normal(s)
    layer = {"w_qkv": d(12, 4), "b_qkv": d(12), "w_out": d(4, 4), "b_out": d(4), "w_up": d(6, 4), "b_up": d(6), "w_down": d(4, 6), "b_down": d(4), "scale1": d(4), "shift1": d(4), "scale2": d(4), "shift2": d(4)}
    x = d(1, 3, 4)
    norm = lambda v, a, b: (v - v.mean()) / math.sqrt(v.var() + 1e-5) * a + b
    q, k, v = (x[0] @ layer["w_qkv"][4 * i : 4 * i + 4].T + layer["b_qkv"][4 * i : 4 * i + 4] for i in range(3))
    for p in range(3):
        mixed = np.zeros(4)
        for head in (slice(0, 2), slice(2, 4)):
            e = np.array([math.exp(q[p, head] @ k[o, head] / math.sqrt(2)) for o in range(3)])
            mixed[head] = sum(e[o] / e.sum() * v[o, head] for o in range(3))
        y = norm(x[0, p] + layer["w_out"] @ mixed + layer["b_out"], layer["scale1"], layer["shift1"])
        y = norm(y + layer["w_down"] @ np.maximum(layer["w_up"] @ y + layer["b_up"], 0) + layer["b_down"], layer["scale2"], layer["shift2"])
        np.testing.assert_allclose(inference.encoder(x, [layer], 2)[0, p], y)
    weights = {"lstm": [{"w_in": d(16, 2), "w_state": d(16, 4), "bias": d(16)}], "encoder": [layer], "heads": 2, "attention": d(4), "fc": d(4), "bias": 0.5}
    rows = spark.createDataFrame([(1, [0.1] * 8), (2, [0.2] * 24), (3, None), (4, []), (5, [1.0] * 7), (6, [NAN] * 8)], "id int, x array<double>")
    got = {r["id"]: (r["a"], r["b"]) for r in rows.select("id", inference.classify("x", 2, weights, "last").alias("a"), inference.classify("x", 2, weights, "max", patches=4).alias("b")).collect()}
    assert got[1][0] == pytest.approx(1 / (1 + math.exp(-inference.forward(np.full((1, 4, 2), 0.1), weights)[0])))
    assert got[2][1] == pytest.approx(1 / (1 + math.exp(-inference.forward(np.full((1, 4, 3, 2), 0.2), weights, "max")[0])))
    assert all(got[k] == (None, None) for k in (3, 4, 5, 6))
    with pytest.raises(ValueError):
        inference.classify("x", 2, weights, "median")


# --- balancing

@pytest.mark.parametrize("n", [0, 1, 4, 5, 99, 1000])
def test_split_sizes(spark, n):
    df = spark.range(n).selectExpr("id", "'c' AS class")
    got = dict(balance.split(df, ["class"], "id").groupBy("split").count().collect())
    part = int(0.2 * n)
    assert {k: v for k, v in {"train": n - 2 * part, "val": part, "test": part}.items() if v} == got


def test_balancing(spark):
    df = spark.range(100).selectExpr("id", "cast(id % 10 = 0 AS int) AS label", "array(cast(id AS double), 1D) AS x")
    assert [r["id"] for r in balance.undersample(df, "label", "id").where("label = 0").orderBy("id").collect()] == [k for k in range(12) if k % 10][:10]
    over = balance.oversample(df, "label", "id")
    assert dict(over.groupBy("label").count().collect()) == {0: 90, 1: 90}
    assert over.where("copy = 0").count() == 100
    made = balance.smote(df, "label", "id", "x", k=3).collect()
    assert len(made) == 80 and all(0 <= r["x"][0] <= 90 and r["x"][1] == 1 for r in made)
    drawn = balance.weighted_draws(df.withColumn("w", F.when(F.col("label") == 1, 9.0).otherwise(1.0)), "id", "w", 4000).join(df, "id")
    assert drawn.count() == 4000 and 0.45 < drawn.where("label = 1").count() / 4000 < 0.55
    per = balance.balanced_batches(df, "label", "id", 20).groupBy("batch", "label").count().collect()
    assert len(per) == 10 and all(r["count"] == 10 for r in per)
    assert balance.balanced_batches(df, "label", "id", 20, compat=True).groupBy("batch").count().first()["count"] == 40
    assert balance.weighted_batches(df, "label", "id", 30).groupBy("batch").count().where("count <> 30").count() == 0
    assert balance.positive_weight(df, "label").first()[0] == 9
    assert balance.class_counts(df.where("label = 1"), "label").orderBy("label").collect() == [(0, 0), (1, 10)]


def test_invalid_samples(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, NAN]), (3, [INF, 1.0]), (4, [None, 1.0]), (5, None), (6, [])]
    assert [r["k"] for r in balance.drop_invalid(spark.createDataFrame(rows, "k long, x array<double>"), "x").collect()] == [1]
    both = balance.labelled({"real": spark.range(2), "fake": spark.range(3)})
    assert dict(both.groupBy("label").count().collect()) == {0: 2, 1: 3}


# --- metrics

def test_metrics_edges(spark):
    one = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.1)], "stage string, y int, score double")
    got = {r["stage"]: r for r in metrics.binary_metrics(one, ["stage"]).collect()}
    assert got["a"]["f1"] == 1 and got["b"]["f1"] == 0 and got["b"]["accuracy"] == 1
    assert metrics.auc(one.where("y = 1")).first()[0] is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, score double")
    assert metrics.auc(ties).first()[0] == 0.5
    big = spark.createDataFrame([("s", 1, 800.0), ("s", 0, -800.0)], "stage string, y int, logit double")
    assert metrics.bce_loss(big, ["stage"]).first()["loss"] == 0


@pytest.mark.parametrize("kind, want", [("last", [3, 0]), ("mean", [2, 1]), ("max", [3, 2]), ("min", [1, 0]), ("mean_max", [2, 1, 3, 2]), ("min_max", [1, 0, 3, 2]), ("avg_pool", [2, 1]), ("max_pool", [3, 2]), ("adaptive_pool", [2, 1, 3, 2])])
def test_readouts(spark, kind, want):
    df = spark.createDataFrame([([[1.0, 2.0], [2.0, 1.0], [3.0, 0.0]],)], "s array<array<double>>")
    assert df.select(metrics.readout("s", kind)).first()[0] == want
    w = np.exp(np.array([3.0, 6.0, 9.0]) - 9)
    assert df.select(metrics.readout("s", "attention", [3.0, 0.0])).first()[0] == pytest.approx((w / w.sum() @ np.array([[1, 2], [2, 1], [3, 0]])).tolist())


# --- geometry, clusters, trials, files

def test_voronoi_cells(spark):
    rng = np.random.default_rng(5)
    points = rng.random((7, 2)) * 10
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(points)]
    got = cluster.voronoi_cells(spark.createDataFrame(rows, "c int, x double, y double"), "c", "x", "y", (0.0, 0.0, 10.0, 10.0)).toPandas()
    area = 0.0
    for c, cell in got.sort_values("i").groupby("c"):
        xs, ys = cell.x.to_numpy(), cell.y.to_numpy()
        area += (xs * np.roll(ys, -1) - ys * np.roll(xs, -1)).sum() / 2
        inside = np.array([xs.mean(), ys.mean()])  # cells are convex
        assert np.argmin(((points - inside) ** 2).sum(1)) == c
        for a, b in zip(xs, ys):  # corners are as near to their own centre as to any other
            far = np.sqrt(((points - [a, b]) ** 2).sum(1))
            assert far[c] <= far.min() + 1e-9
    assert area == pytest.approx(100)


def test_result_files(spark, tmp_path):
    rows = [("POS", 70.0 + k, float(k), "db2", 1, "butter", 2, f"r{k % 2}", -1) for k in range(10)]
    df = spark.createDataFrame(rows, files.RESULT_SCHEMA)
    files.save_results(df, f"{tmp_path}/out")
    back = files.path_columns(files.scan_csv(spark, f"{tmp_path}/out", files.RESULT_SCHEMA), ["subfolder", "roi_type"])
    assert sorted((r["subfolder"], r["roi_type"], r["snr"]) for r in back.collect()) == sorted((r[7], "results", r[2]) for r in rows)
    with pytest.raises(TypeError):
        files.save_results(df.withColumn("snr", F.col("snr").cast("string")), f"{tmp_path}/no")
    held = spark.createDataFrame([(1, {"a": 0.5}, {"lr": "0.1"})], "trial_id long, metrics map<string,double>, params map<string,string>")
    files.save_json(held, f"{tmp_path}/json")
    assert files.load_json(spark, f"{tmp_path}/json", held.schema).collect() == held.collect()


def test_polygons_and_hulls(spark):
    points = spark.createDataFrame([(1, float(x), float(y)) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (0, 0))], "k int, x double, y double")
    hull = cluster.convex_hull(points, "k", "x", "y").orderBy("i").collect()
    assert [(r["x"], r["y"]) for r in hull] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    corners = geometry.convex_corners(points, ["k"])
    grid = spark.range(100).selectExpr("1 AS k", "cast(id % 10 AS double) AS x", "cast(floor(id / 10) AS double) AS y")
    assert geometry.in_convex_polygon(grid, corners, ["k"]).count() == 25
    union = geometry.region_union(spark.createDataFrame([(1, "l"), (1, "r"), (2, "r")], "p int, region string"), {"both": ["l", "r"], "l": ["l"]})
    assert sorted(map(tuple, union.collect())) == [(1, "both"), (1, "l"), (2, "both")]


def test_tracks(spark):
    rows = [(1, f, k, x, y) for f in range(3) for k, (x, y) in enumerate([(10.0 * f, 0.0), (500.0, 5.0 * f)])]
    got = geometry.track_faces(spark.createDataFrame(rows, "v int, f int, k int, x double, y double"), ["v"], "f", "k", "x", "y").collect()
    assert all(r["track_id"] == r["k"] for r in got)


def test_clusters_and_knee(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(np.concatenate([rng.normal(c, 0.2, (50, 2)) for c in ((0, 0), (9, 0), (0, 9))]), columns=["a", "b"])
    found, centres, inertia = cluster.kmeans(spark.createDataFrame(pdf), ["a", "b"], 3)
    assert sorted(r["count"] for r in found.groupBy("cluster").count().collect()) == [50, 50, 50]
    assert sorted(round(a + b) for a, b in centres) == [0, 9, 9] and inertia < 5
    assert cluster.kneedle([100, 20, 10, 8, 7]) == 1
    best, _ = cluster.elbow(spark.createDataFrame(pdf), ["a", "b"], 2, 6)
    assert best == 3


def test_trials(spark):
    rows = spark.createDataFrame([(1, NAN), (2, 0.5), (3, 0.5), (4, None), (5, 0.1)], "trial_id int, loss double")
    ranks = {r["trial_id"]: r["place"] for r in trials.rank_trials(rows, "loss").collect()}
    assert ranks == {5: 1, 2: 2, 3: 3, 1: 4, 4: 5} and trials.best_trial(rows, "loss").first()["trial_id"] == 5
    made = trials.suggest(spark, {"a": ["x", "y"], "b": (1, 3, "int"), "c": (0.1, 10.0, "log"), "d": [7]}, 200, conditions={"d": ("a", "x")}).collect()
    assert {r["b"] for r in made} == {1, 2, 3} and all(0.1 <= r["c"] <= 10 and (r["d"] == 7) == (r["a"] == "x") for r in made)
    epochs = spark.createDataFrame([(1, e, v) for e, v in enumerate([5.0, 4.0, 4.5, 4.6, 4.7, 1.0])], "run int, epoch int, loss double")
    assert tuple(trials.early_stop(epochs, ["run"], "epoch", "loss", 3).first()) == (1, 4, 5)
    rates = [r["learning_rate"] for r in trials.plateau_rate(epochs, ["run"], "epoch", "loss", 1.0, 0.1, 2).orderBy("epoch").collect()]
    assert rates == pytest.approx([1, 1, 1, 1, 0.1, 0.1])


def test_files(spark, tmp_path):
    with pytest.raises(ValueError):
        files.dataset_paths("/d", "Nope")
    assert files.dataset_paths("/d/", "FaceForensics++", "FaceSwap")["deepfake"] == "/d/FaceForensics++/deepfake/FaceSwap"
    df = spark.createDataFrame([("POS", 61.5, 3.0, "None", 0, "bandpass", 2, "cheeks", -1, "train"), ("R", 70.0, 1.0, "db2", 3, "fft_bandpass_wt", 2, "cheeks", 4, "test")], files.RESULT_SCHEMA + ", split STRING")
    out = f"{tmp_path}/out"
    files.save(df, out, ["split"])
    files.save(df.where("split = 'test'").withColumn("snr", F.lit(9.0)), out, ["split"])
    assert sorted(r["snr"] for r in files.scan_signals(spark, out).collect()) == [3.0, 9.0]
    assert files.scan_signals(spark, out, "train", ["cheeks"], ["POS"]).count() == 1
    files.save(df.drop("split"), f"{tmp_path}/csv/a/mask/v1", kind="csv")
    back = files.scan_csv(spark, f"{tmp_path}/csv", files.RESULT_SCHEMA, "part*.csv")
    assert sorted(r["wavelet"] for r in back.collect()) == ["None", "db2"]
    named = files.path_columns(back, ["subfolder", "roi_type", "stem"])
    assert {(r["subfolder"], r["roi_type"], r["stem"]) for r in named.collect()} == {("a", "mask", "v1")}
    assert df.select(files.result_name()).first()[0] == "cheeks_POS_bandpass_o2_None_l0_snr3.00"
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "clip.mp4").write_bytes(b"x")
    assert files.list_videos(spark, {"real": f"{tmp_path}/v"}).first()["video_id"] == "clip"


# --- streaming

def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(v, k, start + timedelta(seconds=k), (k * 7 + v) % 19 != 0) for v in (1, 2) for k in range(90)]
    schema = "video_id long, frame_idx long, ts timestamp, valid boolean"
    for part in range(3):
        own = [r for r in rows if part * 30 <= r[1] < part * 30 + 30]
        spark.createDataFrame(own[::-1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(9, 0, start + timedelta(hours=1), True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = segmenter.stream_segments(stream, 8, 2).writeStream.format("memory").queryName("segments").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.sql("SELECT video_id, run_id, segment_id, t, frame_idx FROM segments WHERE video_id < 9").collect()))
    batch = segments.segments(spark.createDataFrame(rows, schema), ["video_id"], ["frame_idx"], size=8, overlap=2)
    want = sorted((r["video_id"], r["run_id"], r["segment_id"], r["t"], r["frame_idx"]) for r in batch.collect())
    assert got == want and want


def test_groups_of_a_test_dont_gather_their_rows(spark):
    """Few groups of many rows: the rows meet a table of groups without a shuffle by group alone (which made a task a group)."""
    import re

    from pulseloom.operators import significance

    df = spark.range(60_000).selectExpr("cast(id % 3 AS string) AS g", "double((id * 7919) % 10007) AS v")
    for made in (significance.normality(df, "g", "v"), significance.levene(df, "g", "v")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[g#\d+\]", plan)
