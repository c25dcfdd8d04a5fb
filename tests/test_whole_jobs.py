"""Queries that once took a part of their input, against brute force over all of it."""

import duckdb
import numpy as np
import pytest

from pulseloom.functions import dsp
from pulseloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_background_boxes_of_all_orders(spark):
    orders = duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{SF}/orders.parquet'").fetchall()
    ys, xs = np.mgrid[10 : 240 - 10 - 64 + 1, 10 : 320 - 10 - 64 + 1]
    want = {}
    for k, c in orders:
        fx, fy, fw, fh = k % 200, c % 150, 40 + k % 90, 40 + c % 90
        free = ~((xs < fx + fw) & (xs + 64 > fx) & (ys < fy + fh) & (ys + 64 > fy)).ravel()
        at = int(free.argmax())
        want[k] = (int(xs.ravel()[at]), int(ys.ravel()[at])) if free[at] else (None, None)
    got = catalog.QUERIES["background_boxes_all"](spark, SF).collect()
    assert len(got) == len(orders)
    assert {r["k"]: (r["bx"], r["by"]) for r in got} == want


def test_sweep_of_the_full_grid(spark, tmp_path):
    rng = np.random.default_rng(3)
    signals = {k: rng.normal(size=64) + np.sin(np.arange(64) * (0.2 + 0.1 * k)) for k in range(3)}
    rows = [(k, [float(v) for v in x], k) for k, x in signals.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for k, x in signals.items():
        z = dsp.zscore(x.astype(np.float32).astype(float)[None])
        for method in dsp.FILTERS:
            for order in (2, 3, 4, 5, 6):
                tasks = [("None", 0)]
                if method.endswith("_wt"):
                    tasks = [(w, level) for w in dsp.WAVELETS for level in range(1, dsp.max_level(64, w) + 1)]
                for name, level in tasks:
                    y, rate = dsp.apply_filter(z, method, 30.0, order, **({"name": name, "level": level} if level else {}))
                    want[k, method, order, name, level] = (float(dsp.snr(y, z)[0]), float(rate[0]))
    names = ("sample_id", "filter", "filter_order", "wavelet", "wavelet_level")
    got = {tuple(r[n] for n in names): (r["snr"], r["heart_rate"]) for r in catalog.QUERIES["filter_bank"](spark, str(tmp_path)).collect()}
    assert len(want) == 3 * 3420 and set(got) == set(want)
    for task, values in want.items():
        assert got[task] == pytest.approx(values, rel=1e-6, abs=1e-6, nan_ok=True)
    fitting = {t: v[0] for t, v in want.items() if 48 <= v[1] <= 150 and v[0] != 1000}
    best = {k: max(v for t, v in fitting.items() if t[0] == k) for k in {t[0] for t in fitting}}
    chosen = catalog.QUERIES["parameter_sweep"](spark, str(tmp_path)).collect()
    assert {r["sample_id"] for r in chosen} == set(best)
    for r in chosen:
        assert r["snr"] == pytest.approx(best[r["sample_id"]]) == fitting[tuple(r[n] for n in names)]


def test_a_sweep_holds_a_few_signals_at_a_time(spark, monkeypatch):
    """However many signals an Arrow batch has: kernels get at most SAMPLES samples, batches OUTCOMES tasks; slices don't change the outcome."""
    import numpy as np
    import pyarrow as pa
    from pulseloom.functions import dsp
    from pulseloom.operators import spectral

    x = np.random.default_rng(8).normal(size=(600, 32))
    tasks = [(m, 2, "haar" if m.endswith("_wt") else "None", int(m.endswith("_wt"))) for m in dsp.FILTERS[:4]]
    whole = [(values, rates(slice(None))) for _, values, rates in spectral._swept(x, tasks, 30.0, "decibels")]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(x))), "signal": x.tolist()})
    parts = list(spectral._slices(iter([batch])))
    assert max(v.size for _, v in parts) <= spectral.SAMPLES and np.array_equal(np.concatenate([v for _, v in parts]), x)
    assert [k for keys, _ in parts for k in keys.column(0).to_pylist()] == list(range(len(x)))
    grid = spark.createDataFrame(tasks, "filter string, filter_order int, wavelet string, wavelet_level int")
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, signal array<double>")
    got = {(r["k"], r["filter"]): (r["snr"], r["heart_rate"]) for r in spectral.sweep(df, grid, ["k"]).collect()}
    assert len(got) == len(x) * len(tasks)
    assert sorted(np.concatenate([v for v, _ in whole]).tolist()) == sorted(s for s, _ in got.values())
    best = {r["k"]: r["snr"] for r in spectral.best_of_sweep(df, grid, ["k"], low=0, high=1e9).collect()}
    assert best == {k: max(s for (j, _), (s, _) in got.items() if j == k) for k in range(len(x))}
