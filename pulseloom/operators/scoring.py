"""Scores of categories from sweep results: cleaning, SNR, heart rate, proportions, ranking.

Statistics that need a group's mean take it from a first aggregate joined back, so that
rows themselves are never shuffled: both passes are partially aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from pulseloom.functions.quantiles import exact_quantiles


def finite(c: str) -> Column:
    """The column with NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))


def clean_results(df: DataFrame, snr: str = "snr", rate: str = "heart_rate") -> DataFrame:
    """Rows without any missing value (NaN and infinities included) and with non-zero SNR and rate."""
    numeric = {f.name: finite(f.name) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(numeric).dropna("any").where((F.col(snr) != 0) & (F.col(rate) != 0))


def composite_key(df: DataFrame, columns: Sequence[str], name: str | None = None) -> DataFrame:
    """A category that joins columns, as strings, with underscores."""
    return df.withColumn(name or "_".join(columns), F.concat_ws("_", *[F.col(c).cast("string") for c in columns]))


def _penalty(distance: Column, steepness: float) -> Column:
    return F.greatest(1 - F.log1p(steepness * F.abs(distance)), F.lit(0.1))


def snr_scores(df: DataFrame, category: str, threshold: float = 0.0, steepness: float = 0.001, alpha: float = 0.5, beta: float = 0.5, value: str = "snr", with_median: bool = True) -> DataFrame:
    """category, mean, median (three more scans; on demand), std, count, mad, penalty_factor, snr_score. A single-row group has no std and no score."""
    basic = df.groupBy(category).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    mad = df.join(basic.select(category, F.col("mean").alias("_mean")), category).groupBy(category).agg(F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("mad"))
    scored = basic.join(mad, category)
    if with_median:
        scored = scored.join(exact_quantiles(df, [category], value, [0.5], ["median"]), category, "left")
    scored = scored.withColumn("penalty_factor", F.when(F.col("mean") < threshold, _penalty(F.col("mean"), steepness)).otherwise(F.lit(1.0)))
    return scored.withColumn("snr_score", F.col("penalty_factor") / (1 + alpha * F.col("std") + beta * F.col("mad")))


def combined_stats(groups: DataFrame, category: str) -> DataFrame:
    """combined_mean, combined_std and combined_mad from (category, mean, std, count) rows of subgroups."""
    total = groups.groupBy(category).agg((F.sum(F.col("mean") * F.col("count")) / F.sum("count")).alias("combined_mean"), F.sum("count").alias("_n"), F.collect_list("mean").alias("_means"))  # one mean a subgroup
    own = groups.join(total, category).withColumns({
        "_d": F.col("mean") - F.col("combined_mean"),
        "_spread": F.expr("aggregate(_means, 0D, (a, x) -> a + abs(mean - x)) / size(_means)"),
    })
    return own.groupBy(category).agg(F.first("combined_mean").alias("combined_mean"), F.sqrt(F.sum(F.col("count") * (F.col("std") ** 2 + F.col("_d") ** 2)) / F.first("_n")).alias("combined_std"), (F.sum(F.col("_spread") * F.col("count")) / F.first("_n")).alias("combined_mad"))


def hr_scores(df: DataFrame, category: str, low: float = 48, high: float = 150, steepness: float = 0.001, alpha: float = 0.5, beta: float = 0.5, value: str = "heart_rate", subgroup: str = "subfolder") -> DataFrame:
    """category, combined_mean, combined_std, combined_mad, penalty_factor, hr_score."""
    groups = df.groupBy(category, subgroup).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    scored = combined_stats(groups, category)
    mean = F.col("combined_mean")
    penalty = F.when(mean < low, _penalty(low - mean, steepness)).when(mean > high, _penalty(mean - high, steepness)).otherwise(F.lit(1.0))
    return scored.withColumn("penalty_factor", penalty).withColumn("hr_score", F.col("penalty_factor") / (1 + alpha * F.col("combined_std") + beta * F.col("combined_mad")))


def in_range(low: float = 48, high: float = 150, value: str = "heart_rate") -> Column:
    return F.col(value).between(low, high)


def proportions(df: DataFrame, category: str, low: float = 48, high: float = 150, threshold: float = 0.0) -> DataFrame:
    """Shares of a category's rows with the rate in range, the SNR above the threshold, and both."""
    rate, snr = in_range(low, high), F.col("snr") > threshold
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(category).agg(share(rate).alias("hr_in_range_proportion"), share(snr).alias("snr_above_threshold_proportion"), share(rate & snr).alias("combined_in_range_proportion"))


def combined_scores(df: DataFrame, category: str, snr_weight: float = 0.33, hr_weight: float = 0.33, frequency_weight: float = 0.33, low: float = 48, high: float = 150, steepness: float = 0.001, alpha: float = 0.5, beta: float = 0.5, subgroup: str = "subfolder") -> DataFrame:
    """The scores of ``snr_scores``, ``hr_scores`` and ``proportions`` and their weighted sum, in two passes over the rows.

    One aggregate by category and subgroup gives everything but the mean deviation of SNR, whose pass follows.
    """
    rate, above = in_range(low, high), F.col("snr") > 0
    parts = df.groupBy(category, subgroup).agg(
        F.count("*").alias("rows"), F.count("heart_rate").alias("n"), F.avg("heart_rate").alias("mean"), F.stddev_samp("heart_rate").alias("std"),
        F.count("snr").alias("sn"), F.avg("snr").alias("sm"), F.var_pop("snr").alias("sv"),
        F.count_if(rate).alias("in_rate"), F.count_if(above).alias("in_snr"), F.count_if(rate & above).alias("in_both"),
    )
    g = parts.groupBy(category).agg(F.collect_list(F.struct("rows", "n", "mean", "std", "sn", "sm", "sv", "in_rate", "in_snr", "in_both")).alias("g"))  # a row for each subgroup
    total = lambda x: F.expr(f"aggregate(g, 0D, (a, x) -> a + coalesce({x}, 0D))")
    g = g.withColumns({"_n": total("x.n"), "_sn": total("x.sn"), "_rows": total("x.rows")})
    g = g.withColumns({"mean": F.try_divide(total("x.sn * x.sm"), F.col("_sn")), "combined_mean": F.try_divide(total("x.n * x.mean"), F.col("_n"))})
    g = g.withColumns({
        "std": F.when(F.col("_sn") > 1, F.sqrt(total("x.sn * (x.sv + (x.sm - mean) * (x.sm - mean))") / (F.col("_sn") - 1))),
        "combined_std": F.when(F.exists("g", lambda x: x["std"].isNotNull()), F.sqrt(total("x.n * (x.std * x.std + (x.mean - combined_mean) * (x.mean - combined_mean))") / F.col("_n"))),
        "combined_mad": total("x.n * aggregate(g, 0D, (t, y) -> t + coalesce(abs(x.mean - y.mean), 0D))") / F.size(F.filter("g", lambda x: x["mean"].isNotNull())) / F.col("_n"),
        "hr_in_range_proportion": total("x.in_rate") / F.col("_rows"), "snr_above_threshold_proportion": total("x.in_snr") / F.col("_rows"), "combined_in_range_proportion": total("x.in_both") / F.col("_rows"),
    }).drop("g", "_n", "_sn", "_rows")
    mad = df.join(g.select(category, F.col("mean").alias("_mean")), category).groupBy(category).agg(F.avg(F.abs(F.col("snr") - F.col("_mean"))).alias("mad"))
    pulse = F.col("combined_mean")
    snr_penalty = F.when(F.col("mean") < 0, _penalty(F.col("mean"), steepness)).otherwise(F.lit(1.0))
    hr_penalty = F.when(pulse < low, _penalty(low - pulse, steepness)).when(pulse > high, _penalty(pulse - high, steepness)).otherwise(F.lit(1.0))
    scored = g.join(mad, category).withColumns({"snr_score": snr_penalty / (1 + alpha * F.col("std") + beta * F.col("mad")), "hr_score": hr_penalty / (1 + alpha * F.col("combined_std") + beta * F.col("combined_mad"))})
    return scored.withColumn("combined_score", F.col("snr_score") * snr_weight + F.col("hr_score") * hr_weight + F.col("combined_in_range_proportion") * frequency_weight)


def top_n(df: DataFrame, score: str, n: int, ties: str) -> DataFrame:
    """The n rows of largest score; missing scores come last and ties go by the named column."""
    return df.orderBy(F.col(score).desc_nulls_last(), ties).limit(n)


def keep_categories(df: DataFrame, chosen: DataFrame, category: str) -> DataFrame:
    """Rows whose category is among the chosen ones."""
    return df.join(chosen.select(category), category, "left_semi")


def with_scores(df: DataFrame, scores: DataFrame, category: str, *columns: str) -> DataFrame:
    """Rows with their category's scores; rows without one are kept."""
    return df.join(scores.select(category, *columns), category, "left")


def analyze_category(df: DataFrame, category: str, n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All categories by combined score, the best n, and the rows of the best."""
    scores = combined_scores(df, category)
    best = top_n(scores, "combined_score", n, category)
    return scores.orderBy(F.col("combined_score").desc_nulls_last(), category), best, keep_categories(df, best, category)


def best_combinations(df: DataFrame, groupings: Sequence[Sequence[str]], n: int = 20) -> DataFrame:
    """The best n categories of each list of columns, in one frame: grouping, category, scores."""
    found = None
    for columns in groupings:
        name = "_".join(columns)
        keyed = composite_key(df, columns, "category")
        own = top_n(combined_scores(keyed, "category"), "combined_score", n, "category").withColumn("grouping", F.lit(name))
        found = own if found is None else found.unionByName(own)
    return found


def by_groupings(df: DataFrame, groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Every row once for each list of columns: grouping (the columns' names) and category (their values), both joined by underscores."""
    each = [F.struct(F.lit("_".join(g)).alias("grouping"), F.concat_ws("_", *[F.col(c).cast("string") for c in g]).alias("category")) for g in groupings]
    return df.select("*", F.explode(F.array(*each)).alias("_k")).select("*", "_k.*").drop("_k")


def correlations(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations as (metric_a, metric_b, correlation)."""
    pairs = [(a, b) for a in metrics for b in metrics]
    row = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of row by column and each row's percentages."""
    counts = df.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    total = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return counts.select(row, *[F.col(f"`{v}`").alias(f"n_{v}") for v in values], *[(100 * F.col(f"`{v}`") / total).alias(f"pct_{v}") for v in values])


def iqr_bounds(df: DataFrame, category: str, metric: str, reach: float = 1.5) -> DataFrame:
    """Whiskers of each category from exact quartiles."""
    q = exact_quantiles(df, [category], metric, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(category, "q1", "q3", (F.col("q1") - reach * iqr).alias("lower"), (F.col("q3") + reach * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, category: str, metric: str, reach: float = 1.5) -> DataFrame:
    """Rows outside their category's whiskers."""
    bounds = iqr_bounds(df, category, metric, reach).select(category, "lower", "upper")
    return df.join(bounds, category).where((F.col(metric) < F.col("lower")) | (F.col(metric) > F.col("upper"))).drop("lower", "upper")


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, by the schema."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def label_codes(df: DataFrame, category: str, name: str = "code") -> DataFrame:
    """Categories numbered from 0 in alphabetical order."""
    distinct = df.select(category).where(F.col(category).isNotNull()).distinct()
    codes = distinct.withColumn(name, F.dense_rank().over(Window.orderBy(category)) - 1)  # one row a category
    return df.join(codes, category, "left")


def title_case(c: str) -> Column:
    """Underscores as blanks, words with capitals."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def best_in_range(df: DataFrame, low: float = 48, high: float = 150, sentinel: float = 1000.0, order: str = "seq") -> DataFrame:
    """The row of highest SNR with its rate in range and no sentinel; ties go to the first in order. No row if none fits."""
    fitting = df.where(in_range(low, high) & (F.col("snr") != sentinel))
    return fitting.orderBy(F.col("snr").desc(), order).limit(1)


def kde_peak(df: DataFrame, category: str, metric: str, points: int = 200) -> DataFrame:
    """Where each category's Gaussian kernel density (Scott's width) is highest, over a grid between its extremes.

    Rows are counted in 4,096 bins of their category first, so memory is bounded; the grid is
    evaluated at the bins' centres by weight.
    """
    span = df.where(F.col(metric).isNotNull()).groupBy(category).agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"))
    width = (F.col("hi") - F.col("lo")) / 4096
    binned = df.join(span, category).withColumn("b", F.when(width > 0, F.least(F.floor((F.col(metric) - F.col("lo")) / width), F.lit(4095))).otherwise(F.lit(0))).groupBy(category, "lo", "hi", "sd", "n", "b").agg(F.avg(metric).alias("x"), F.count("*").alias("w"))
    packed = binned.groupBy(category, "lo", "hi", "sd", "n").agg(F.collect_list(F.struct("x", "w")).alias("bins"))  # at most 4,096
    h = F.col("sd") * F.pow(F.col("n"), -0.2)
    grid = packed.withColumn("h", h).where("h > 0").withColumn("at", F.explode(F.expr(f"transform(sequence(0, {points - 1}), i -> lo + (hi - lo) * i / {points - 1})")))
    dense = grid.withColumn("density", F.expr("aggregate(bins, 0D, (a, p) -> a + p.w * exp(-0.5D * (at - p.x) * (at - p.x) / (h * h))) / (n * h * sqrt(2 * pi()))"))
    return dense.groupBy(category).agg(F.min(F.struct(-F.col("density"), "at"))["at"].alias("peak"), F.max("density").alias("density"))
