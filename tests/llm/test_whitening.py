import math

import numpy as np
import pytest

from pulseloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component int"


def brute(rows, top=8):
    kept = [(i, [math.floor(1024 * v) + 100_000 for v in e]) for i, e in rows]
    n, size = len(kept), len(kept[0][1])
    sums = [sum(x[d] for _, x in kept) for d in range(size)]
    off = np.array([[n * v - s for v, s in zip(x, sums)] for _, x in kept], float) / n
    v = off.T @ off / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    deviation = {i: sum((n * v - s) ** 2 for v, s in zip(x, sums)) for i, x in kept}
    return n, deviation, dict(zip([i for i, _ in kept], off @ axes / np.sqrt(values))), values / np.trace(v)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    rows = [(k, (rng.normal(size=12) @ mix).tolist()) for k in range(400)]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1e300] * 12)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows + bad], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    n, deviation, white, explained = brute(rows)
    assert len(got) == 400 * 8 and {r["component"] for r in got} == set(range(1, 9)) and {r["n"] for r in got} == {n}
    sign = {}
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]]
        want, c = white[r["vec_id"]][r["component"] - 1], r["component"]
        if abs(want) > 1e-3:
            sign.setdefault(c, np.sign(want * r["whitened"]))
        assert r["whitened"] * sign.get(c, 1) == pytest.approx(want, abs=1e-8)
        assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    w = np.array([[r["whitened"] for r in sorted((r for r in got if r["component"] == c), key=lambda r: r["vec_id"])] for c in range(1, 9)])
    assert np.abs(np.cov(w, bias=True) - np.eye(8)).max() < 1e-10


def test_whole_table(spark):
    got = whitening.whiten(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    rows = got.collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    n, deviation, _, explained = brute(vectors)
    assert len(rows) == 8 * n and all(r["deviation"] == deviation[r["vec_id"]] for r in rows)
    assert all(r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9 for r in rows)


def test_small_flat_and_empty(spark):
    assert whitening.whiten(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 1)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(1, c, 1, 0, None, None, None) for c in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k % 3), 5.0], "x", 1) for k in range(9)] + [(1, [1.0, 5.0], "x", 1)], SCHEMA)).collect()
    assert len(flat) == 20 and all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-12
    lengths = whitening.whiten(spark.createDataFrame([(k, [float(k * j % 7) for j in range(2 + k % 2)], "x", 1) for k in range(40)], SCHEMA)).collect()
    assert {(r["vec_id"] % 2, r["component"]) for r in lengths} == {(0, 1), (0, 2), (1, 1), (1, 2), (1, 3)} and {r["n"] for r in lengths} == {20}


def test_beyond_64_bits():
    x = np.array([[2**50, -(2**50)], [3, 4]])
    n, sums = 2**20, np.array([5, -7], object)
    off = whitening.centred(x, n, sums)
    assert off.tolist() == [[n * a - s for a, s in zip(row, (5, -7))] for row in x.tolist()]
    assert whitening.deviations(off) == [None, sum((n * a - s) ** 2 for a, s in zip((3, 4), (5, -7)))]
