"""Standardisation, K-means, elbow, cluster statistics, hulls and small regressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def standardise(df: DataFrame, metrics: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Columns less their mean over the population deviation; a constant column becomes 0."""
    stats = df.agg(*[f(m).alias(f"{p}{m}") for m in metrics for p, f in (("_m_", F.avg), ("_s_", F.stddev_pop))])
    rows = df.join(F.broadcast(stats))  # one row
    return rows.select(*df.columns, *[((F.col(m) - F.col(f"_m_{m}")) / F.when(F.col(f"_s_{m}") > 0, F.col(f"_s_{m}")).otherwise(F.lit(1.0))).alias(m + suffix) for m in metrics])


def kmeans(df: DataFrame, metrics: Sequence[str], clusters: int, seed: int = 42, steps: int = 50) -> tuple[DataFrame, list[list[float]], float]:
    """``df`` with cluster and distance, the centroids in the metrics' own units, and the inertia in standard units."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    z = standardise(df.dropna(subset=list(metrics)), metrics)
    points = VectorAssembler(inputCols=[m + "_z" for m in metrics], outputCol="_p").transform(z)
    model = KMeans(featuresCol="_p", predictionCol="cluster", k=clusters, seed=seed, maxIter=steps).fit(points)
    centres = model.clusterCenters()
    scale = df.dropna(subset=list(metrics)).agg(*[f(m) for m in metrics for f in (F.avg, F.stddev_pop)]).first()
    own = [[float(c[i] * (scale[2 * i + 1] or 1.0) + scale[2 * i]) for i in range(len(metrics))] for c in centres]
    at = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres]), F.col("cluster") + 1)
    far = F.sqrt(F.aggregate(F.zip_with(vector_to_array("_p"), at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    found = model.transform(points).withColumn("distance", far).drop("_p", *[m + "_z" for m in metrics])
    return found, own, float(model.summary.trainingCost)


def _nearest_centre(metrics: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """(number, squared distance) of the nearest of a few centres; ties go to the lowest number."""
    far = [sum(((F.col(m) - F.lit(float(v))) ** 2 for m, v in zip(metrics, c)), F.lit(0.0)) for c in centres]
    return F.array_min(F.array(*[F.struct(d.alias("far"), F.lit(i).alias("cluster")) for i, d in enumerate(far)]))


def minibatch_step(batch: DataFrame, metrics: Sequence[str], centres: Sequence[Sequence[float]], weights: Sequence[float]) -> tuple[list[list[float]], list[float]]:
    """Centres and weights after one batch: each centre moves to the mean of all rows it was ever given, those before by their number."""
    own = batch.select(_nearest_centre(metrics, centres)["cluster"].alias("cluster"), *metrics).groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in metrics])
    moved, heavier = [list(c) for c in centres], list(weights)
    for r in own.collect():  # one row a centre
        c, before = r["cluster"], weights[r["cluster"]]
        heavier[c] = before + r["n"]
        moved[c] = [(v * before + r[m]) / heavier[c] for v, m in zip(centres[c], metrics)]
    return moved, heavier


def minibatch_kmeans(df: DataFrame, metrics: Sequence[str], clusters: int, id_: str, seed: int = 42, batch: int = 1024, steps: int = 30) -> tuple[DataFrame, list[list[float]], float]:
    """``df`` with cluster and distance (in standard units), the centroids in the metrics' own units, and the inertia in standard units.

    Each step takes the rows whose id's hash with the step's number is small: about ``batch`` of them, by one scan with the condition pushed into it. First centres are
    those of k-means|| over such a sample. Only centres reach the driver. Every row is assigned at the end. Fewer rows than clusters give as many centres as there are.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    clean = df.dropna(subset=list(metrics))
    z = standardise(clean, metrics)
    names = [m + "_z" for m in metrics]
    scale = clean.agg(F.count("*").alias("n"), *[f(m) for m in metrics for f in (F.avg, F.stddev_pop)]).first()
    share = min(1.0, batch / max(scale["n"], 1))
    drawn = lambda step: z.where(F.pmod(F.xxhash64(F.col(id_), F.lit(seed), F.lit(step)), F.lit(2**30)) < F.lit(int(share * 2**30) + 1))
    first = VectorAssembler(inputCols=names, outputCol="_p").transform(drawn(-1))
    centres = [[float(v) for v in c] for c in KMeans(featuresCol="_p", k=clusters, seed=seed, initMode="k-means||", maxIter=1).fit(first).clusterCenters()]
    weights = [0.0] * len(centres)
    for step in range(steps):
        centres, weights = minibatch_step(drawn(step), names, centres, weights)
    best = _nearest_centre(names, centres)
    found = z.withColumn("_b", best).withColumns({"cluster": F.col("_b.cluster"), "distance": F.sqrt("_b.far")}).drop("_b", *names)
    inertia = found.agg(F.sum(F.col("distance") ** 2)).first()[0] or 0.0
    own = [[c[i] * (scale[2 * i + 2] or 1.0) + scale[2 * i + 1] for i in range(len(metrics))] for c in centres]
    return found, own, float(inertia)


def kneedle(values: Sequence[float]) -> int:
    """Index of the knee of a convex, falling curve: the largest drop below its chord (first wins)."""
    y = np.asarray(values, float)
    x = np.linspace(0, 1, len(y))
    y = (y - y.min()) / ((y.max() - y.min()) or 1)
    return int(np.argmax(1 - y - x))


def elbow(df: DataFrame, metrics: Sequence[str], low: int = 2, high: int = 10, seed: int = 42) -> tuple[int, list[tuple[int, float]]]:
    """The number of clusters at the knee of the inertias, and those."""
    found = [(k, kmeans(df, metrics, k, seed)[2]) for k in range(low, high + 1)]
    return found[kneedle([v for _, v in found])][0], found


def cluster_stats(df: DataFrame, cluster: str, metrics: Sequence[str]) -> DataFrame:
    """Size, centre and within-cluster sample variance of each metric."""
    return df.groupBy(cluster).agg(F.count("*").alias("size"), *[F.avg(m).alias(f"centre_{m}") for m in metrics], *[F.var_samp(m).alias(f"var_{m}") for m in metrics])


def centre_variance(stats: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return stats.agg(*[F.var_pop(f"centre_{m}").alias(f"var_{m}") for m in metrics])


def convex_hull(df: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """(cluster, i, x, y): each cluster's hull, from its lowest point, counter-clockwise.

    Each Arrow batch sends on its own hull of every cluster; a cluster's task makes one hull of these.
    """
    kind = df.schema[cluster].dataType.simpleString()

    def hull(points: np.ndarray) -> np.ndarray:
        points = np.unique(points, axis=0)
        if len(points) < 3:
            return points

        def half(order: np.ndarray) -> list:
            out: list = []
            for p in order:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return np.array(half(points) + half(points[::-1]))

    def partial(batches):
        for batch in batches:
            for name, part in batch.groupby("c"):
                h = hull(part[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({"c": name, "x": h[:, 0], "y": h[:, 1]})

    def final(key, part):
        h = hull(part[["x", "y"]].to_numpy(float))
        h = np.roll(h, -int(np.lexsort((h[:, 0], h[:, 1]))[0]), axis=0)
        return pd.DataFrame({cluster: key[0], "i": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    rows = df.select(F.col(cluster).alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return rows.mapInPandas(partial, f"c {kind}, x double, y double").groupBy("c").applyInPandas(final, f"{cluster} {kind}, i int, x double, y double")


def regression(df: DataFrame, key: Sequence[str], y: str, x1: str, x2: str) -> DataFrame:
    """Least squares of y on x1 and x2 with intercept: a, b, c. Null where x1 and x2 are collinear."""
    m = df.groupBy(*key).agg(F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"), F.covar_pop(x1, x2).alias("c12"), F.covar_pop(x1, y).alias("c1"), F.covar_pop(x2, y).alias("c2"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"))
    det = F.nullif(F.col("v1") * F.col("v2") - F.col("c12") ** 2, F.lit(0.0))
    a, b = (F.col("c1") * F.col("v2") - F.col("c12") * F.col("c2")) / det, (F.col("c2") * F.col("v1") - F.col("c12") * F.col("c1")) / det
    return m.select(*key, a.alias("a"), b.alias("b"), (F.col("my") - a * F.col("m1") - b * F.col("m2")).alias("c"))


def voronoi_cells(centres: DataFrame, name: str, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(name, i, x, y): the part of a box (x low, y low, x high, y high) that is nearest to each centre, as corners counter-clockwise.

    Each cell is the box cut by the half planes towards all other centres, which are few: one row a cluster. Centres at one place share a cell.
    """
    kind = centres.schema[name].dataType.simpleString()
    rows = centres.select(F.col(name).alias("n"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    every = rows.agg(F.collect_set(F.struct("x", "y")).alias("others"))

    def cut(batches):
        for batch in batches:
            for n, cx, cy, others in zip(batch["n"], batch["x"], batch["y"], batch["others"]):
                cell = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
                for o in others:
                    dx, dy = o["x"] - cx, o["y"] - cy
                    if dx == 0 and dy == 0:
                        continue
                    limit = (o["x"] ** 2 + o["y"] ** 2 - cx**2 - cy**2) / 2
                    side = [dx * px + dy * py - limit for px, py in cell]
                    kept = []
                    for k, (p, s) in enumerate(zip(cell, side)):
                        q, t = cell[k - 1], side[k - 1]
                        if (s <= 0) != (t <= 0):
                            u = t / (t - s)
                            kept.append((q[0] + u * (p[0] - q[0]), q[1] + u * (p[1] - q[1])))
                        if s <= 0:
                            kept.append(p)
                    cell = kept
                if cell:
                    yield pd.DataFrame({name: [n] * len(cell), "i": range(len(cell)), "x": [p[0] for p in cell], "y": [p[1] for p in cell]})

    return rows.join(F.broadcast(every)).mapInPandas(cut, f"{name} {kind}, i int, x double, y double")  # one row
