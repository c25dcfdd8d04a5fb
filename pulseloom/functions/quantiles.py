"""Exact order statistics of groups without gathering a group: nested bins and grouped quantiles (linear interpolation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.session import scratch

BINS = 4096
CROWD = 100_000
#: Bins to a doubling, and what keeps bins of positive and negative numbers apart.
OCTAVE, FAR = 256, 300_000


def first_bin(value: str) -> Column:
    """A number that sorts as the value does, by its logarithm: outliers of any size leave the other bins as they are. NaN comes last."""
    v = F.col(value).cast("double")
    octave = lambda x: F.floor(OCTAVE * F.least(F.log2(x), F.lit(1024.0))).cast("int")
    return F.when(F.isnan(v), 2 * FAR).when(v > 0, FAR + octave(v)).when(v < 0, -FAR - octave(-v)).when(v == 0, 0)


def part_of(value: str, low: str, high: str, bins: int) -> Column:
    """Which of as many equal parts of [low, high] the value lies in."""
    width = (F.col(high) - F.col(low)) / bins
    return F.when(width > 0, F.least(F.floor((F.col(value) - F.col(low)) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def nested_bins(rows: DataFrame, keys: Sequence[str], value: str, name: str = "_b", bins: int = BINS, crowd: int = CROWD) -> DataFrame:
    """``rows`` with a struct of bin numbers that sorts as ``value`` does within its keys.

    The first number is ``first_bin``. Bins of more than ``crowd`` rows, such as those of values that lie close together far from
    zero, are cut again into equal parts of their own span.
    """
    rows = rows.withColumn(f"{name}0", first_bin(value))
    at = [*keys, f"{name}0"]
    span = rows.groupBy(*at).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_rows"))
    span = span.where((F.col("_rows") > crowd) & (F.col("_hi") > F.col("_lo"))).drop("_rows")  # few: crowded bins alone
    return rows.join(span, at, "left").withColumn(name, F.struct(F.col(f"{name}0").alias("first"), part_of(value, "_lo", "_hi", bins).alias("second"))).drop("_lo", "_hi", f"{name}0")


def _located(ranks: DataFrame, counts: DataFrame, keys: Sequence[str], bin_: str) -> DataFrame:
    """``ranks(keys, _i, _s, _r)`` with the bin of ``counts(keys, bin, _c)`` that each lies in and, as _r, its place within the bin."""
    upto = Window.partitionBy(*keys).orderBy(bin_)
    counts = counts.withColumn("_to", F.sum("_c").over(upto)).withColumn("_from", F.col("_to") - F.col("_c"))
    return ranks.join(counts, list(keys)).where("_r >= _from AND _r < _to").withColumn("_r", F.col("_r") - F.col("_from")).drop("_to", "_from", "_c")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], bins: int = BINS, crowd: int = CROWD) -> DataFrame:
    """One row a group: keys and a column for each probability; nulls are passed over.

    One aggregate of the source gives the groups' sizes and their bins; that small table is written and tells in which bin a wanted
    rank lies. A second reading takes the distinct values of those bins, which are ordered one bin to a task. Only where a
    wanted bin is crowded, a reading between the two cuts it into equal parts. Every shuffle but of those values is of pre-aggregated counts.
    """
    keys = list(keys)
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", first_bin("_v"))
    path = scratch(spark, "bins")
    rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).write.parquet(path)
    binned = spark.read.parquet(path)
    sizes = binned.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    places = [F.struct(F.lit(i).alias("i"), F.lit(side).alias("s"), (F.floor(F.lit(p) * (F.col("_n") - 1)) + side).cast("long").alias("r")) for i, p in enumerate(probs) for side in (0, 1)]
    ranks = sizes.select(*keys, "_n", F.explode(F.array(*places)).alias("w")).select(*keys, F.col("w.i").alias("_i"), F.col("w.s").alias("_s"), F.least(F.col("w.r"), F.col("_n") - 1).alias("_r"))
    crowded = binned.where((F.col("_c") > crowd) & (F.col("_hi") > F.col("_lo"))).select(*keys, "_b", "_lo", "_hi")
    wanted = _located(ranks, binned.select(*keys, "_b", "_c"), keys, "_b").withColumn("_p", F.lit(-1))
    parted = rows.withColumn("_p", F.lit(-1))
    if not crowded.isEmpty():
        asked = wanted.select(*keys, "_b").distinct()
        inside = rows.join(crowded.join(asked, [*keys, "_b"], "left_semi"), [*keys, "_b"], "left")
        parted = inside.withColumn("_p", F.when(F.col("_lo").isNull(), -1).otherwise(part_of("_v", "_lo", "_hi", bins))).drop("_lo", "_hi")
        counts = parted.join(asked, [*keys, "_b"], "left_semi").groupBy(*keys, "_b", "_p").agg(F.count("*").alias("_c"))
        wanted = _located(wanted.drop("_p"), counts, [*keys, "_b"], "_p")
    near = parted.join(wanted.select(*keys, "_b", "_p").distinct(), [*keys, "_b", "_p"], "left_semi")
    grouped = near.groupBy(*keys, "_b", "_p", "_v").agg(F.count("*").alias("_c"))
    found = _located(wanted, grouped, [*keys, "_b", "_p"], "_v")
    pick = lambda i, s: F.max(F.when((F.col("_i") == i) & (F.col("_s") == s), F.col("_v")))
    ends = found.groupBy(*keys).agg(*[pick(i, s).alias(f"_q{i}{s}") for i in range(len(probs)) for s in (0, 1)]).join(sizes, keys)
    part = lambda p: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))
    return ends.select(*keys, *[(F.col(f"_q{i}0") + (F.col(f"_q{i}1") - F.col(f"_q{i}0")) * part(p)).alias(n) for i, (p, n) in enumerate(zip(probs, names))])
