"""Binary classification metrics, curves and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions.quantiles import nested_bins


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def binary_metrics(df: DataFrame, key: Sequence[str], y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and the area of the thresholded curve, (1 + TPR - FPR) / 2; undefined parts are 0."""
    hit = F.col(score) > threshold
    count = lambda c: F.count_if(c)
    t = df.groupBy(*key).agg(count(hit & (F.col(y) == 1)).alias("tp"), count(hit & (F.col(y) == 0)).alias("fp"), count(~hit & (F.col(y) == 1)).alias("fn"), count(~hit & (F.col(y) == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall = _or_zero(F.try_divide(tp, tp + fn))
    return t.select(*key, "tp", "fp", "fn", "tn", _or_zero(F.try_divide(tp + tn, tp + fp + fn + tn)).alias("accuracy"), _or_zero(F.try_divide(tp, tp + fp)).alias("precision"), recall.alias("recall"), _or_zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), ((1 + recall - _or_zero(F.try_divide(fp, fp + tn))) / 2).alias("auroc_thresholded"))


def confusion(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), (F.col(score) > threshold).cast("int").alias("y_hat")).agg(F.count("*").alias("count"))


def _score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """Distinct scores with counts of both classes and of all larger scores; running sums by blocks of scores."""
    counts = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    rows = nested_bins(counts, [], "score", "b")
    over = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn")).select("b", F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("n0"))  # bins, not scores
    inside = Window.partitionBy("b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(blocks, "b").select("score", "p", "n", (F.col("p0") + F.sum("p").over(inside)).alias("tp"), (F.col("n0") + F.sum("n").over(inside)).alias("fp"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, tpr, fpr) for each distinct score: rows with at least that score are called positive."""
    points = _score_counts(df, y, score)
    total = points.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return points.join(F.broadcast(total)).select(F.col("score").alias("threshold"), F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_n").alias("fpr"))


def auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the curve by the trapezoid rule: each score's negatives meet the positives above it and half of its own."""
    points = _score_counts(df, y, score)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    return points.agg(F.try_divide(area, F.sum("p") * F.sum("n").cast("double")).alias("auc"))


def bce_loss(df: DataFrame, key: Sequence[str], y: str = "y", logit: str = "logit", pos_weight: float | Column = 1.0) -> DataFrame:
    """Mean binary cross-entropy of logits in the stable form; the weight is kept within 1e-5 and 1e5."""
    w = F.greatest(F.least(pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight)), F.lit(1e5)), F.lit(1e-5))
    x, t = F.col(logit), F.col(y)
    soft = F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return df.groupBy(*key).agg(F.avg((1 - t) * x + (1 + (w - 1) * t) * soft).alias("loss"))


def sigmoid(c: str) -> Column:
    return 1 / (1 + F.exp(-F.col(c)))


def readout(states: str, kind: str, attention: Sequence[float] = ()) -> Column:
    """A sequence of state vectors (array of arrays) to one vector: last, mean, max, min, their pairs, avg_pool, max_pool, adaptive_pool (average and
    largest) or attention (softmax over the states' products with the given vector)."""
    s = f"cast({states} AS array<array<double>>)"
    width = f"sequence(0, size({states}[0]) - 1)"
    pick = lambda f: f"transform({width}, j -> {f})"
    single = {
        "last": f"element_at({s}, -1)",
        "mean": pick(f"aggregate({s}, 0D, (a, v) -> a + v[j]) / size({states})"),
        "max": pick(f"array_max(transform({s}, v -> v[j]))"),
        "min": pick(f"array_min(transform({s}, v -> v[j]))"),
    }
    single |= {"avg_pool": single["mean"], "max_pool": single["max"], "adaptive_pool": f"concat({single['mean']}, {single['max']})"}
    score = f"transform({s}, v -> aggregate(zip_with(v, array({', '.join(f'{float(x)!r}D' for x in attention)}), (a, b) -> a * b), 0D, (t, u) -> t + u))"
    weights = f"transform(array({score}), q -> transform(q, u -> exp(u - array_max(q))))[0]"
    single["attention"] = f"transform(array({weights}), w -> {pick(f'aggregate(zip_with({s}, w, (v, p) -> v[j] * p), 0D, (t, u) -> t + u) / aggregate(w, 0D, (t, u) -> t + u)')})[0]"
    if kind == "attention" and not attention:
        raise ValueError("attention needs its vector")
    if kind in single:
        return F.expr(single[kind])
    a, _, b = kind.partition("_")
    if a in ("mean", "max", "min") and b in ("mean", "max", "min"):
        return F.expr(f"concat({single[a]}, {single[b]})")
    raise ValueError(f"unknown readout {kind}")


def positional_encoding(spark, positions: int, width: int) -> DataFrame:
    """(position, j, value): sine on even and cosine on odd places."""
    rows = spark.range(positions).select(F.col("id").alias("position"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    angle = F.col("position") * F.exp(-F.log(F.lit(10000.0)) * (F.col("j") - F.col("j") % 2) / width)
    return rows.withColumn("value", F.when(F.col("j") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)))
