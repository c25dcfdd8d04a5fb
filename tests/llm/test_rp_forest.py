import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import rp_forest as rf

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows):
    n = len(rows)
    x = np.zeros((n, 16))
    ok = np.zeros(n, bool)
    for k, (_, e, label, _) in enumerate(rows):
        if e is not None and label is not None and len(e) == 16 and None not in e and np.isfinite(e).all() and np.any(np.array(e) != 0):
            x[k], ok[k] = np.array(e, np.float32), True
    norm = np.where(ok, np.linalg.norm(x, axis=1), 1)
    label = np.array([r[2] if r[2] is not None else -1 for r in rows])
    near = (x @ x.T / norm[:, None] / norm[None] >= 0.93) & ok[:, None] & ok[None] & (label[:, None] == label[None])
    near &= ~np.eye(n, dtype=bool)
    comp = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(comp, np.where(near, comp[None], 2**60).min(1))
        if (new == comp).all():
            return near.sum(1), comp
        comp = new


def vectors(n, seed, hot):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    rows = []
    for k in range(n):
        rows.append((int(k * 3 + 1), base[k].tolist(), int(rng.integers(3)), "x"))
        if k % 4 == 0:
            rows.append((int(k * 3 + 2), (base[k] * 2 + rng.standard_normal(16) * 0.4).tolist(), rows[-1][2], "x"))
        if k % 9 == 0:
            rows.append((int(k * 3 + 3), base[k].tolist(), rows[-1][2], "x"))
    centre = rng.standard_normal(16)
    rows += [(100_000 + k, (centre + rng.standard_normal(16) * 0.08).tolist(), 1, "x") for k in range(hot)]
    rows += [(200_000 + k, centre.tolist(), 1, "x") for k in range(30)]
    nan = float("nan")
    rows += [(300_000, None, 1, "x"), (300_001, [0.0] * 16, 1, "x"), (300_002, [0.0] * 16, 1, "x"), (300_003, [nan] + [1.0] * 15, 1, "x"), (300_004, [float("inf")] + [1.0] * 15, 1, "x"), (300_005, [None] + [1.0] * 15, 1, "x"), (300_006, centre.tolist(), None, "x"), (300_007, [], 1, "x"), (300_008, [-0.0, 1.0] + [0.0] * 14, 2, "x"), (300_009, [0.0, 1.0] + [0.0] * 14, 2, "x"), (300_010, [1.0] * 3, 2, "x")]
    return rows


@pytest.mark.parametrize("leaf_rows, tile_rows", [(40, 1024), (100_000, 16)])
def test_links_against_brute_force(spark, leaf_rows, tile_rows):
    rows = vectors(500, 1, 150)
    links, comp = brute(rows)
    got = {r["vec_id"]: r for r in rf.forest_components(spark.createDataFrame(rows, SCHEMA), leaf_rows=leaf_rows, tile_rows=tile_rows).collect()}
    assert len(got) == len(rows)
    found = np.array([got[r[0]]["n_links"] for r in rows])
    assert (found <= links).all()
    assert found.sum() >= 0.97 * links.sum()
    if leaf_rows > 1000:
        assert (found == links).all()
        assert [got[r[0]]["component_id"] for r in rows] == comp.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_in_deep_trees(spark):
    """Ten levels and more: leaves of four rows of 3,600."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3000, 64))
    mate = base[:600] + rng.standard_normal((600, 64)) * 0.38
    rows = [(k, v.tolist(), 0, "x") for k, v in enumerate(np.concatenate([base, mate]))]
    unit = np.concatenate([base, mate]).astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    classes = spark.createDataFrame([(k, e, "a") for k, e, _, _ in rows], "rep long, embedding array<float>, label string")
    places = {r["rep"]: set(r["leaves"]) for r in rf.grow(classes, 1, 3, 0.45 * np.sqrt(0.14), 7).groupBy("rep").agg(F.collect_set("leaf").alias("leaves")).collect()}
    pairs = np.argwhere(np.triu(near, 1))
    assert len(pairs) > 200
    met = np.mean([bool(places[a] & places[b]) for a, b in pairs.tolist()])
    print("of one tree", met, "of six", 1 - (1 - met) ** 6)
    assert 1 - (1 - met) ** 6 >= 0.9  # trees are drawn independently
    paths = [f & ((1 << 56) - 1) for p in places.values() for f in p]
    assert np.median([p.bit_length() - 1 for p in paths]) >= 10


def test_leaves_stay_small(spark):
    """Leaves hold few rows whatever the labels; a label of scaled copies can't be split."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(16).tolist(), k % 2) for k in range(2400)]
    rows += [(10_000 + k, [float(x) * (k + 1) for x in range(1, 17)], 7) for k in range(60)]
    classes = spark.createDataFrame(rows, "rep long, embedding array<double>, label string")
    leaves = rf.grow(classes, 2, 32, 0.1, 7)
    sizes = {(r["label"], r["leaf"]): r["count"] for r in leaves.groupBy("label", "leaf").count().collect()}
    assert max(n for (label, _), n in sizes.items() if label != "7") <= 32
    assert [n for (label, _), n in sizes.items() if label == "7"] == [60, 60]
    placed = leaves.select("rep", F.shiftright("leaf", 56).alias("tree")).distinct().count()
    assert placed == 2 * len(rows)  # every row is in every tree


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 1, "x"), (5, [1.0, 0.1], 1, "x"), (5, [0.0, 1.0], 1, "x"), (None, [-1.0, 0.0], 1, "x"), (None, [-1.0, 0.0], 1, "x")]
    got = rf.forest_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["vec_id"] is None, r["n_links"], r["component_id"]) for r in got), key=str) == sorted([(True, 1, 5), (False, 1, 5), (False, 0, 5), (True, 1, None), (True, 1, None)], key=str)


def test_double_vectors_stay_double(spark):
    near = [1.0, float(np.tan(np.arccos(0.93)) * (1 - 1e-12))]
    far = [1.0, float(np.tan(np.arccos(0.93)) * (1 + 1e-9))]
    rows = [(1, [1.0, 0.0], 1), (2, near, 1), (3, [2.0, 0.0, 0.0], 2), (4, [*far, 0.0], 2)]
    got = {r["vec_id"]: r["n_links"] for r in rf.forest_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_empty_and_unusable(spark):
    assert rf.forest_components(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, 1, "x"), (1, None, 1, "x"), (2, [0.0], None, "x")]
    got = rf.forest_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]


def test_every_length_of_a_label_links(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(16).tolist(), 1, "x") for k in range(40)]
    for k in range(12):
        v = rng.standard_normal(8)
        rows += [(100 + 2 * k, v.tolist(), 1, "x"), (101 + 2 * k, (v + rng.standard_normal(8) * 0.01).tolist(), 1, "x")]
    got = {r["vec_id"]: r for r in rf.forest_components(spark.createDataFrame(rows, SCHEMA), leaf_rows=1000).collect()}
    for k in range(12):
        assert got[101 + 2 * k]["n_links"] >= 1 and got[100 + 2 * k]["component_id"] == got[101 + 2 * k]["component_id"]


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(6, 8))
    rows = [(10 * k + j, (base[k] * s * (1 + 1e-3 * rng.normal(size=8))).tolist(), 1) for k in range(6) for j, s in enumerate((1e300, 1.0, 1e-300))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rf.forest_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    for i, v in unit.items():
        assert got[i][0] == sum(cosine(v, w) >= 0.93 for j, w in unit.items() if j != i) >= 2
        assert got[i][1] <= i // 10 * 10
