import hashlib
import math

import duckdb
import numpy as np
import pytest

from pulseloom.llm import centroid_clusters as cc
from pulseloom.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def brute(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"1:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centroids = [kept[r][1] for r in order[:k]]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids] for _, x in kept]
        chosen = [row.index(min(row)) for row in far]
        if step < rounds:
            for c in range(len(centroids)):
                own = [x for (_, x), d in zip(kept, chosen) if d == c]
                if own:
                    centroids[c] = [sum(v) // len(own) for v in zip(*own)]
    own = [row[c] for row, c in zip(far, chosen)]
    return sorted((i, c, d, sum(e for e, f in zip(own, chosen) if f == c), sum(own), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, chosen, own))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=64).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(0, rows[0][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [float("nan")] + [0.0] * 63), (305, [float("inf")] + [0.0] * 63), (306, [0.0] * 64), (307, [-0.001] * 64)]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)
    got = sorted(tuple(r) for r in cc.cluster(df).collect())
    assert got == brute(rows)


def test_few_and_none(spark):
    rows = [(5, [1.0] * 64), (6, [2.0] * 64)]
    assert sorted(tuple(r) for r in cc.cluster(spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)).collect()) == brute(rows)
    empty = cc.cluster(spark.createDataFrame([(1, None, 1, "x")], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    nobody = spark.createDataFrame([(None, [1.0] * 64, 1, "x"), (7, [9.0] * 64, 1, "x")], SCHEMA)
    assert sorted((r["vec_id"] or -1, r["cluster"]) for r in cc.cluster(nobody).collect()) == [(-1, 1), (7, 0)]


def test_huge_components_are_exact(spark):
    rows = [(k, [float(np.float32(s * 1e30 * (k + 1)))] * 64) for k, s in ((0, 1), (1, -1), (2, 1))] + [(10 + k, [float(k)] * 64) for k in range(20)]
    got = {r["vec_id"]: r for r in cc.cluster(spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["cluster"] == w[1] and got[k]["distance"] == (w[2] if w[2] < 2**63 else None) and got[k]["centroid_sha256"] == w[5]


@pytest.mark.parametrize("size", [1, 3, 200, 5000, 2**20, 2**26])
def test_screening_never_loses_the_nearest(size):
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size + 1, (16, 64))
    # vectors half-way between two centroids, a step off, and anywhere
    x = np.concatenate([(c[rng.integers(0, 16, 300)] + c[rng.integers(0, 16, 300)]) // 2 + rng.integers(-1, 2, (300, 64)), rng.integers(-size, size + 1, (300, 64)), c])
    far = cc.distances(x.astype(object), c.astype(object))
    least = far.min(1)
    possible = cc.screen(x, c)
    assert all(possible[i][[d == least[i] for d in row]].all() for i, row in enumerate(far))
    chosen, distance = cc.nearest(x, c)
    assert chosen.tolist() == [row.tolist().index(m) for row, m in zip(far, least)] and distance.tolist() == least.tolist()


def test_screening_decides_most_vectors():
    rng = np.random.default_rng(2)
    assert (cc.screen(rng.integers(-64, 65, (2000, 64)), rng.integers(-64, 65, (16, 64))).sum(1) == 1).mean() > 0.9


def test_query_and_sql_agree(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        want = con.execute(queries.ORACLE["op12_centroid_clusters"]).fetchall()
    got = queries.op12_centroid_clusters(spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 500
