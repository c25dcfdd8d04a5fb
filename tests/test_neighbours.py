"""Exact neighbours: as brute force gives them, with ever fewer comparisons of clustered rows."""

import numpy as np
import pytest

from pulseloom.operators import neighbours as nb

SCHEMA = "kind string, n long, x array<double>"


def brute(rows, k):
    out = {}
    for g in {r[0] for r in rows}:
        own = [(n, np.array(x)) for h, n, x in rows if h == g]
        points = np.stack([x for _, x in own])
        for n, x in own:
            far = np.sqrt(((points - x) ** 2).sum(1))
            out[g, n] = sorted((d, m) for d, (m, _) in zip(far.tolist(), own) if m != n)[:k]
    return out


def clustered(rng, n, groups=("a", "b"), size=6, centres=20):
    at = rng.normal(size=(centres, size)) * 40
    return [(groups[k % len(groups)], k, (at[rng.integers(centres)] + rng.normal(size=size)).tolist()) for k in range(n)]


@pytest.mark.parametrize("k, options", [(3, {}), (100, {"cell": 32}), (5, {"cell": 16, "tile": 24}), (7, {"cell": 10**6})])
def test_against_brute_force(spark, k, options):
    rng = np.random.default_rng(k)
    rows = clustered(rng, 500) + [("c", 9000 + j, [float(j), 0.0, 0.0]) for j in range(4)] + [("lone", 1, [1.0, 2.0])]
    rows += [("a", 7000 + j, rows[0][2]) for j in range(5)]  # copies and ties
    bad = [("a", 8000, None), ("a", 8001, []), ("a", 8002, [1.0, None]), ("a", 8003, [float("nan")] * 6), (None, 8004, [1.0] * 6), ("a", None, [1.0] * 6)]
    got = {}
    for r in nb.nearest_neighbours(spark.createDataFrame(rows + bad, SCHEMA), "n", "x", k, group="kind", **options).collect():
        got.setdefault((r["g"], r["id"]), []).append((r["place"], r["distance"], r["neighbour"]))
    want = {key: v for key, v in brute(rows, k).items() if v}
    assert set(got) == set(want)
    for key, own in got.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(1, len(want[key]) + 1))
        assert [d for _, d, _ in own] == pytest.approx([d for d, _ in want[key]], abs=1e-9)
        assert [m for _, _, m in own] == [m for _, m in want[key]]


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([("x", j, [float(j * j)]) for j in range(10)], SCHEMA)
    got = nb.nearest_neighbours(df, "n", "x", 1).collect()
    assert {r["id"]: r["neighbour"] for r in got} == {0: 1, **{j: j - 1 for j in range(1, 10)}}
    assert nb.nearest_neighbours(df.where("n < 0"), "n", "x", 1).collect() == []


def compared(n, per_cell=16, k=10):
    """Pairs that meet, for rows in clusters whose number grows with n."""
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(size=(50, 4)) for c in rng.normal(size=(n // 50, 4)) * 100])
    pivots = x[rng.choice(n, n // per_cell, replace=False)]
    cell = nb.squared(x, pivots).argmin(1)
    far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
    each = [far[cell == c] for c in range(len(pivots))]
    cells = nb.Cells(pivots, np.array([len(e) for e in each]), np.array([e.max(initial=0) for e in each]), [np.sort(e)[: k + 1] for e in each], k)
    return sum(len(own) * sum(int((cells.floor[i, j] <= e).sum()) for j, e in enumerate(each)) for i, own in enumerate(each))


def test_comparisons_grow_below_quadratically():
    small, large = compared(2000), compared(8000)
    assert small < 0.1 * 2000**2 and np.log(large / small) / np.log(4) < 1.5


def test_rows_without_structure_are_sent_a_bounded_number_of_times(spark):
    """Where no cell rules another out, a row goes to blocks, not to every cell (which took an executor's memory)."""
    rng = np.random.default_rng(3)
    n, pivots = 6000, 375
    x = rng.normal(size=(n, 64))
    x /= np.sqrt((x**2).sum(1))[:, None]
    cell = nb.squared(x, x[:pivots]).argmin(1)
    far = np.sqrt(((x - x[:pivots][cell]) ** 2).sum(1))
    each = [far[cell == c] for c in range(pivots)]
    cells = nb.Cells(x[:pivots], np.array([len(e) for e in each]), np.array([e.max(initial=0) for e in each]), [np.sort(e)[:6] for e in each], 5)
    cells.pack(128)
    sent = (cells.need[:, cell].T <= far[:, None]).sum(1) + cells.tiles[cells.first[cell]]
    assert sent.max() <= 4 * nb.BLOCKS < (cells.floor[:, cell].T <= far[:, None]).sum(1).mean()


def test_nearest_of_equal_distances(monkeypatch):
    """Rows all equally far apart, and copies, a few at a time."""
    for name, value in (("ROWS", 7), ("OTHERS", 11), ("PAIRS", 13)):
        monkeypatch.setattr(nb, name, value)
    x = np.concatenate([np.eye(40), np.eye(40)[:3]])
    names = np.arange(43)[::-1].copy()
    row, col, distance = nb.nearest_of(x, names, x, names, 4)
    want = brute([("a", int(m), v.tolist()) for m, v in zip(names, x)], 4)
    for r in range(43):
        assert [(d, m) for d, m in zip(distance[row == r].tolist(), names[col[row == r]].tolist())] == want["a", int(names[r])]


def test_smote_numbers_its_rows_once(spark):
    """The search and the draws read the numbered rows from storage: no window is left to be sorted again in each step."""
    from pulseloom.operators import balance

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(k % 4 == 0), k, rng.normal(size=64).tolist()) for k in range(400)], "kind int, n long, x array<double>")
    made = balance.smote(df, "kind", "n", "x", k=3)
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 200
