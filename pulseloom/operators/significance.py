"""Tests of difference between groups. Rows are reduced to one small aggregate a test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.functions import special
from pulseloom.functions.quantiles import exact_quantiles, nested_bins
from pulseloom.session import scratch


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: made once, and joins know its true size, so that a table of groups doesn't send all rows to a task a group."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _tail(of, *columns: Column) -> Column:
    """A tail probability: one call a test, on the statistics of a whole table. Null where one is null, or degrees of freedom are below one."""
    safe = lambda x, *d: None if x is None or any(k is None or k < 1 for k in d) else of(x, *d)
    return F.udf(safe, "double")(*columns)


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, n, ss_between, ss_within, f, eta_squared, p_value. Nulls where a part is undefined."""
    m = _stored(group_moments(df, group, value), "moments")
    total = m.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"))
    between = m.join(F.broadcast(total.select("grand"))).agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ss_between"))  # one row
    both = total.join(F.broadcast(between))
    f = F.try_divide(F.col("ss_between") / F.nullif(F.col("groups") - 1, F.lit(0)), F.col("ss_within") / F.nullif(F.col("n") - F.col("groups"), F.lit(0)))
    found = both.select("groups", "n", "ss_between", "ss_within", f.alias("f"), F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("eta_squared"))
    return found.withColumn("p_value", _tail(special.f_tail, F.col("f"), F.col("groups") - 1, F.col("n") - F.col("groups")))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """ANOVA of absolute deviations from each group's median."""
    medians = _stored(exact_quantiles(df, [group], value, [0.5], ["_median"]), "medians")
    away = df.join(medians, group).select(group, F.abs(F.col(value) - F.col("_median")).alias("_away"))
    return anova(away, group, "_away")


def ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, rank): average ranks of distinct values.

    Values are counted first; the running count goes by nested bins, whose totals are few.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ties = nested_bins(counts.groupBy("value").agg(F.sum("n").alias("t")), [], "value", "b")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ties.groupBy("b").agg(F.sum("t").alias("bt")).select("b", F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("before"))  # bins, not values
    inside = Window.partitionBy("b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ties.join(blocks, "b").select("value", "t", (F.col("before") + F.coalesce(F.sum("t").over(inside), F.lit(0)) + (F.col("t") + 1) / 2).alias("rank"))
    return counts.join(ranks, "value")


def kruskal(df: DataFrame, group: str, value: str, ranks: DataFrame | None = None) -> DataFrame:
    """One row: groups, n, h (corrected for ties; null if all values are one), p_value. ``ranks`` are those of ``ranked`` if they are at hand."""
    r = _stored(ranked(df, group, value), "ranks") if ranks is None else ranks
    own = r.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    sums = own.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") ** 2 / F.col("n")).alias("s"))
    ties = r.select("value", "t").distinct().agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / F.nullif(n**3 - n, F.lit(0.0)), F.lit(0.0))
    return sums.join(F.broadcast(ties)).select("groups", "n", h.alias("h")).withColumn("p_value", _tail(special.chi2_tail, F.col("h"), F.col("groups") - 1))


def dunn(df: DataFrame, group: str, value: str, ranks: DataFrame | None = None) -> DataFrame:
    """group_a < group_b, z and p_adjusted (two-sided, Bonferroni) from mean ranks of all groups. ``ranks`` as for ``kruskal``."""
    r = _stored(ranked(df, group, value), "ranks") if ranks is None else ranks
    own = r.groupBy(group).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("rank")) / F.sum("n")).alias("m"))
    total = own.agg(F.sum("n").alias("all_n"), (F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    ties = r.select("value", "t").distinct().agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    a, b = own.select(F.col(group).alias("group_a"), F.col("n").alias("na"), F.col("m").alias("ma")), own.select(F.col(group).alias("group_b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    n = F.col("all_n").cast("double")
    spread = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb"))
    pairs = a.join(b, F.col("group_a") < F.col("group_b")).join(F.broadcast(total)).join(F.broadcast(ties))  # groups, not rows
    tail = F.udf(lambda z: None if z is None else 2 * special.normal_tail(abs(z)), "double")  # one call a pair of groups
    z = (F.col("ma") - F.col("mb")) / F.sqrt(F.nullif(spread, F.lit(0.0)))
    return pairs.select("group_a", "group_b", z.alias("z"), "pairs").select("group_a", "group_b", "z", F.least(tail("z") * F.col("pairs"), F.lit(1.0)).alias("p_adjusted"))


def cohens_d(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row for exactly two groups (first less second in the order of names): d with unweighted pooling; none otherwise."""
    m = group_moments(df, group, value).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "mean", "var"))).alias("g")).where(F.size("g") == 2)
    return m.select(F.try_divide(F.col("g")[0]["mean"] - F.col("g")[1]["mean"], F.sqrt((F.col("g")[0]["var"] + F.col("g")[1]["var"]) / 2)).alias("d"))


def normality(df: DataFrame, group: str, value: str, most: int = 5000) -> DataFrame:
    """(group, n, test, statistic, p_value): Shapiro-Wilk up to ``most`` values, else Kolmogorov-Smirnov against the standard normal.

    Large groups are never gathered: their statistic is a maximum over ranked values.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = _stored(rows.groupBy("g").agg(F.count("*").alias("n")), "sizes")
    small = rows.join(sizes.where(F.col("n") <= most), "g").groupBy("g").agg(F.collect_list("v").alias("v"), F.first("n").alias("n"))  # bounded by ``most``
    wilk = F.udf(lambda v: special.shapiro(list(v)), "struct<statistic:double,p_value:double>")
    shapiro = small.select("g", "n", F.lit("shapiro").alias("test"), wilk("v").alias("x")).select("g", "n", "test", "x.*")
    counted = rows.join(sizes.where(F.col("n") > most), "g").groupBy("g", "n", "v").agg(F.count("*").alias("c"))
    counted = nested_bins(_stored(counted, "counted"), ["g"], "v", "b")
    blocks = counted.groupBy("g", "b").agg(F.sum("c").alias("t"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("c").over(Window.partitionBy("g", "b").orderBy("v")) + F.col("before")
    steps = counted.join(blocks.select("g", "b", "before"), ["g", "b"]).withColumn("upto", upto)

    @F.pandas_udf("double")
    def below(v):
        return v.map(lambda x: 1 - special.normal_tail(x))

    far = F.greatest(F.abs(F.col("upto") / F.col("n") - F.col("cdf")), F.abs((F.col("upto") - F.col("c")) / F.col("n") - F.col("cdf")))
    ks = steps.withColumn("cdf", below("v")).groupBy("g", "n").agg(F.max(far).alias("statistic"))
    tail = F.udf(lambda d, n: special.kolmogorov_tail(d, n), "double")
    ks = ks.select("g", "n", F.lit("ks").alias("test"), "statistic", tail("statistic", "n").alias("p_value"))
    return shapiro.unionByName(ks).withColumnRenamed("g", group)


def compare_groups(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> dict:
    """Which test applies, its p-value and effect: ANOVA if all groups are normal with equal variances, else Kruskal-Wallis,
    then with Dunn's test of all pairs as ``post_hoc`` (a frame, not run here). Less than two groups: no test.

    The driver sees one row for each group and one for each test.
    """
    sizes = [r["n"] for r in group_moments(df, group, value).select("n").collect()]
    result: dict = {"test_used": "Not enough groups", "p_value": None, "normality": None, "homoscedasticity": None, "effect_size": None, "significant": None, "post_hoc": None}
    if len(sizes) < 2:
        return result
    normal = all(r["p_value"] > alpha for r in normality(df, group, value).select("p_value").collect())
    equal = False
    if min(sizes) >= 2:
        p = levene(df, group, value).first()["p_value"]
        equal = p is not None and p > alpha
    post_hoc = None
    if normal and equal:
        r = anova(df, group, value).first()
        p, used, effect = r["p_value"], "ANOVA", r["eta_squared"]
    else:
        ranks = _stored(ranked(df, group, value), "ranks")
        p, used = kruskal(df, group, value, ranks).first()["p_value"], "Kruskal-Wallis"
        effect = cohens_d(df, group, value).first()["d"] if len(sizes) == 2 else None
        post_hoc = dunn(df, group, value, ranks)
    p = math.nan if p is None else p
    return {"test_used": used, "p_value": p, "normality": normal, "homoscedasticity": equal, "effect_size": effect, "significant": p < alpha, "post_hoc": post_hoc}
