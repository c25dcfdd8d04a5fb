"""Hyper-parameter trials as tables: spaces, ranking, stopping rules, schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulseloom.operators.balance import MODULUS, mixed


def suggest(spark: SparkSession, space: Mapping[str, Sequence | tuple[float, float, str]], trials: int, seed: int = 42, conditions: Mapping[str, tuple[str, object]] | None = None) -> DataFrame:
    """trial_id and a column for each parameter: a choice from a list, or a number between two bounds ('linear', 'log' or 'int').

    conditions: parameter -> (other, value): null unless the other one has that value.
    """
    rows = spark.range(trials).withColumnRenamed("id", "trial_id")
    for k, (name, own) in enumerate(space.items()):
        u = (mixed("trial_id", seed + 31 * (k + 1)) + 0.5) / MODULUS
        if isinstance(own, tuple):
            low, high, kind = own
            made = {"linear": low + (high - low) * u, "log": F.exp(F.log(F.lit(float(low))) + (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))) * u), "int": F.floor(low + (high - low + 1) * u)}[kind]
        else:
            made = F.element_at(F.array(*[F.lit(v) for v in own]), (F.floor(u * len(own)) + 1).cast("int"))
        rows = rows.withColumn(name, made)
    for name, (other, value) in (conditions or {}).items():
        rows = rows.withColumn(name, F.when(F.col(other) == F.lit(value), F.col(name)))
    return rows


def rank_trials(trials: DataFrame, metric: str, ascending: bool = True, key: Sequence[str] = (), trial: str = "trial_id") -> DataFrame:
    """Trials with place from 1 by metric; missing and NaN metrics come last, ties go to the earlier trial."""
    clean = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric))
    order = clean.asc_nulls_last() if ascending else clean.desc_nulls_last()
    return trials.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(order, trial)))


def best_trial(trials: DataFrame, metric: str, ascending: bool = True, trial: str = "trial_id") -> DataFrame:
    """The first trial by metric."""
    clean = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric))
    return trials.orderBy(clean.asc_nulls_last() if ascending else clean.desc_nulls_last(), trial).limit(1)


def pair_counts(trials: DataFrame, params: str = "params") -> DataFrame:
    """How often two parameter values occur together: (a, b, count) of 'name=value' strings with a < b."""
    items = F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat_ws("=", e["key"], e["value"])))
    rows = trials.select(items.alias("i"))
    pairs = F.flatten(F.transform("i", lambda a, k: F.transform(F.slice("i", k + 2, F.greatest(F.size("i") - k - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("count"))


def early_stop(epochs: DataFrame, key: Sequence[str], epoch: str, metric: str, patience: int = 5) -> DataFrame:
    """Each run's best epoch so far, and the first epoch at which ``patience`` epochs brought nothing better."""
    time = Window.partitionBy(*key).orderBy(epoch)
    best = F.min(metric).over(time.rowsBetween(Window.unboundedPreceding, -1))
    better = best.isNull() | (F.col(metric) < best)
    marked = epochs.withColumn("_b", F.when(better, F.col(epoch)))
    since = marked.withColumn("_last", F.max("_b").over(time.rowsBetween(Window.unboundedPreceding, 0)))
    return since.groupBy(*key).agg(F.min(F.when(F.col(epoch) - F.col("_last") >= patience, F.col(epoch))).alias("stop_epoch"), F.max("_b").alias("best_epoch"))


def learning_rate(kind: str, step: str, base: float, total: int, floor: float = 0.0, gamma: float = 0.95) -> Column:
    """Schedule as a column: cosine, exponential or constant."""
    t = F.col(step).cast("double")
    if kind == "cosine":
        return floor + (base - floor) * (1 + F.cos(pi * t / total)) / 2
    if kind == "exponential":
        return base * F.pow(F.lit(gamma), t)
    if kind == "constant":
        return F.lit(base)
    raise ValueError(f"unknown schedule {kind}")


def plateau_rate(epochs: DataFrame, key: Sequence[str], epoch: str, metric: str, base: float, factor: float = 0.1, patience: int = 10) -> DataFrame:
    """Rate of each epoch: multiplied by the factor after every ``patience`` epochs without a better metric, counted from the last better one."""
    time = Window.partitionBy(*key).orderBy(epoch)
    best = F.min(metric).over(time.rowsBetween(Window.unboundedPreceding, -1))
    marked = epochs.withColumn("_b", F.when(best.isNull() | (F.col(metric) < best), F.col(epoch)))
    since = F.col(epoch) - F.max("_b").over(time.rowsBetween(Window.unboundedPreceding, 0))
    cut = marked.withColumn("_cut", F.when((since > 0) & (since % (patience + 1) == 0), 1).otherwise(0))
    return cut.withColumn("learning_rate", base * F.pow(F.lit(factor), F.sum("_cut").over(time))).drop("_b", "_cut")
