"""Samples for classification: cleaning, labels, splits, batches, class weights, balancing, sampling.

"Random" choices are arithmetic on ids and a seed, so that they repeat, don't depend on
partitioning, and can be checked elsewhere. Row numbers over a whole class come from
counts of hash blocks and a window inside a block: no class is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseloom.operators.neighbours import nearest_neighbours
from pulseloom.session import scratch

MODULUS = 4294967296
BLOCKS = 1024


def mixed(id_: str, seed: int = 42) -> Column:
    """A 32-bit mix of an integer id that any SQL engine can repeat."""
    first = (F.col(id_) % 1000003 * 2654435761 + F.lit(seed * 97)) % MODULUS
    return ((first % 65536) * 40503 + F.floor(first / 65536) * 60493 + F.col(id_) % 65536) % MODULUS


def numbered(df: DataFrame, key: Sequence[str], block: Column, order: Sequence[Column], name: str = "n") -> DataFrame:
    """Rows numbered from 0 within a key by (block, order), block being a column of few, ordered values."""
    rows = df.withColumn("_b", block)
    counts = rows.groupBy(*key, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if key else Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_b").orderBy(*order)
    return rows.join(counts, [*key, "_b"]).withColumn(name, (F.col("_before") + F.row_number().over(inside) - 1).cast("long")).drop("_b", "_before")


def shuffled(df: DataFrame, key: Sequence[str], id_: str, seed: int = 42, name: str = "n") -> DataFrame:
    """Rows numbered within a key in mixed order."""
    rows = df.withColumn("_h", mixed(id_, seed))
    return numbered(rows, key, F.floor(F.col("_h") / (MODULUS // BLOCKS)), [F.col("_h"), F.col(id_)], name).drop("_h")


def split(df: DataFrame, key: Sequence[str], id_: str, test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with split: a key's rows in mixed order give train, then val, then test, with sizes rounded down for val and test."""
    rows = shuffled(df, key, id_, seed, "_n")
    sizes = df.groupBy(*key).agg(F.count("*").alias("_total"))
    n_test, n_val = F.floor(F.lit(test) * F.col("_total")), F.floor(F.lit(val) * F.col("_total"))
    n_train = F.col("_total") - n_test - n_val
    named = F.when(F.col("_n") < n_train, "train").when(F.col("_n") < n_train + n_val, "val").otherwise("test")
    return rows.join(sizes, list(key)).withColumn("split", named).drop("_n", "_total")


def batches(df: DataFrame, id_: str, size: int) -> DataFrame:
    """``df`` with batch: ids in order, ``size`` to a batch. Ids are integers."""
    span = df.agg(F.min(id_).alias("_lo"), F.max(id_).alias("_hi"))
    rows = df.join(F.broadcast(span))
    block = F.floor((F.col(id_) - F.col("_lo")) / F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / BLOCKS), F.lit(1)))
    return numbered(rows, [], block, [F.col(id_)], "_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n", "_lo", "_hi")


def overlapping(df: DataFrame, id_: str, split_: str = "split") -> DataFrame:
    """Ids that occur in several splits, with how many; none should."""
    return df.groupBy(id_).agg(F.countDistinct(split_).alias("splits")).where("splits > 1")


def drop_invalid(df: DataFrame, features: str) -> DataFrame:
    """Samples whose array has no null, NaN or infinite element and isn't null or empty."""
    ok = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(ok & (F.size(features) > 0), F.lit(False)))


def reshape(c: str, width: int) -> Column:
    """An array as rows of ``width``; null if it doesn't divide."""
    return F.when(F.size(c) % width == 0, F.transform(F.sequence(F.lit(0), F.greatest((F.size(c) / width).cast("int") - 1, F.lit(0))), lambda i: F.slice(c, i * width + 1, width)))


def flatten_patches(df: DataFrame, patches: str, name: str = "patch") -> DataFrame:
    return df.select("*", F.posexplode(patches).alias("patch_idx", name)).drop(patches)


def labelled(classes: Mapping[str, DataFrame]) -> DataFrame:
    """Classes under each other with label 0, 1, .. in the given order; columns are matched by name."""
    out = None
    for k, df in enumerate(classes.values()):
        own = df.withColumn("label", F.lit(k).cast("long"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """label and count, gaps between 0 and the largest label as 0."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("count"))
    every = counts.agg(F.max(label).alias("m")).select(F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(0)).cast("int"))).alias(label))
    return every.join(counts, label, "left").select(F.col(label).cast("long").alias(label), F.coalesce("count", F.lit(0)).alias("count"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives over positives; 1 if a class is missing."""
    return df.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).select(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") / F.nullif("b", F.lit(0))).otherwise(F.lit(1.0)).alias("pos_weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """balanced: n / (classes * count); weighted: 1 / count, normalised to sum 1."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("n"), F.count("*").alias("k"), F.sum(1 / F.col("count")).alias("s"))
    return counts.join(F.broadcast(total)).select(label, "count", (F.col("n") / (F.col("k") * F.col("count"))).alias("balanced"), (1 / F.col("count") / F.col("s")).alias("weighted"))


def undersample(df: DataFrame, label: str, id_: str) -> DataFrame:
    """As many rows of each class as the smallest has: the first by id."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    least = counts.agg(F.min("_c").alias("_least"))
    span = df.agg(F.min(id_).alias("_lo"), F.max(id_).alias("_hi"))
    rows = df.join(F.broadcast(span))
    block = F.floor((F.col(id_) - F.col("_lo")) / F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / BLOCKS), F.lit(1)))
    return numbered(rows, [label], block, [F.col(id_)], "_n").join(F.broadcast(least)).where("_n < _least").drop("_n", "_least", "_lo", "_hi")


def oversample(df: DataFrame, label: str, id_: str, seed: int = 42) -> DataFrame:
    """Every class as large as the largest: its rows, and as many draws with replacement as are missing (copy > 0).

    Draw k of a class takes its row number (mix of k) modulo its size, so draws are counted per row and rows repeated in place.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    most = counts.agg(F.max("_c").alias("_most"))
    missing = counts.join(F.broadcast(most)).where("_most > _c").select(label, "_c", (F.col("_most") - F.col("_c")).alias("_need"))
    draws = missing.select(label, "_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("_need") - 1) / 65536))).alias("_part"), "_need")
    draws = draws.repartition(label, "_part").select(label, "_c", F.explode(F.sequence(F.col("_part") * 65536, F.least(F.col("_need"), (F.col("_part") + 1) * 65536) - 1)).alias("_k"))
    picked = draws.withColumn("_n", mixed("_k", seed) % F.col("_c")).groupBy(label, "_n").agg(F.count("*").alias("_times"))
    rows = shuffled(df, [label], id_, seed, "_n")
    repeated = rows.join(picked, [label, "_n"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("_times", F.lit(0)).cast("int"))))
    return repeated.drop("_n", "_times")


def smote(df: DataFrame, label: str, id_: str, features: str, k: int = 5, seed: int = 42) -> DataFrame:
    """New rows of the smaller classes until all are equal: x + u * (neighbour - x), the neighbour one of the k nearest of the class (``nearest_neighbours``).

    Classes with one row repeat it.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    most = counts.agg(F.max("_c").alias("_most"))
    need = counts.join(F.broadcast(most)).where("_most > _c").withColumn("_need", F.col("_most") - F.col("_c"))
    rows = shuffled(df.join(need.select(label), label, "left_semi"), [label], id_, seed, "_n").select(label, id_, F.col(features).cast("array<double>").alias("x"), "_n")
    path = scratch(df.sparkSession, "smote")
    rows.write.parquet(path)  # numbered once, read by each step of the search
    rows = df.sparkSession.read.parquet(path)
    near = nearest_neighbours(rows.select(label, "_n", "x"), "_n", "x", k, group=label)
    best = near.groupBy(F.col("g").alias(label), F.col("id").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("place", F.col("neighbour").alias("m")))).alias("near"))  # k
    draws = need.select(label, "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_need") - 1)).alias("_k"))
    draws = draws.withColumns({"_n": F.col("_k") % F.col("_c"), "_h": mixed("_k", seed)})
    start = rows.select(label, "_n", "x")
    picked = draws.join(start, [label, "_n"]).join(best, [label, "_n"], "left")
    picked = picked.withColumn("m", F.when(F.size("near") > 0, F.get("near", (F.col("_h") % F.greatest(F.size("near"), F.lit(1))).cast("int"))["m"]))
    other = rows.select(label, F.col("_n").alias("m"), F.col("x").alias("y"))
    u = (F.floor(F.col("_h") / 64) % 65536) / 65536
    made = picked.join(other, [label, "m"], "left")
    return made.select(label, "_k", F.when(F.col("y").isNull(), F.col("x")).otherwise(F.zip_with("x", "y", lambda a, b: a + u * (b - a))).alias(features))


def weighted_draws(df: DataFrame, id_: str, weight: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, id): draws with replacement in proportion to weight.

    Weights become intervals of [0, total) by block sums; draw k falls at a mixed place and meets its interval through
    an equal-width grid: no join by range.
    """
    spark = df.sparkSession
    rows = df.where(F.col(weight) > 0).select(F.col(id_).alias("id"), F.col(weight).cast("double").alias("w")).withColumn("_b", F.pmod(F.col("id"), F.lit(BLOCKS)))
    sums = rows.groupBy("_b").agg(F.sum("w").alias("s"))
    sums = sums.select("_b", F.coalesce(F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    total = rows.agg(F.sum("w").alias("total"))
    inside = Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(sums, "_b").withColumn("hi", F.col("before") + F.sum("w").over(inside)).withColumn("lo", F.col("hi") - F.col("w")).join(F.broadcast(total))
    cells = F.lit(65536.0)
    first = F.floor(F.col("lo") / F.col("total") * cells)
    last = F.least(F.floor(F.col("hi") / F.col("total") * cells), F.lit(65535))
    gridded = placed.withColumn("cell", F.explode(F.sequence(first.cast("int"), last.cast("int")))).select("id", "lo", "hi", "total", "cell")
    at = spark.range(draws).withColumn("u", (mixed("id", seed) + 0.5) / MODULUS).select(F.col("id").alias("draw"), "u", F.floor(F.col("u") * cells).cast("int").alias("cell"))
    hit = at.join(gridded, "cell").where("u * total >= lo AND u * total < hi")
    return hit.groupBy("draw").agg(F.min("id").alias(id_))


def balanced_batches(df: DataFrame, label: str, id_: str, size: int, seed: int = 42, compat: bool = False) -> DataFrame:
    """(batch, label, slot, id): every batch holds size / classes draws of each class (``compat``: size // 2 * classes of each)."""
    spark = df.sparkSession
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    facts = counts.agg(F.count("*").alias("k"), F.sum("_c").alias("n")).first()  # one row
    each = max(1, size // 2 * facts["k"] if compat else size // max(facts["k"], 1))
    n_batches = -(-facts["n"] // size)
    slots = spark.range(n_batches * each).select(F.floor(F.col("id") / each).alias("batch"), (F.col("id") % each).alias("slot"), F.col("id").alias("_k"))
    draws = slots.join(F.broadcast(counts)).withColumn("_n", mixed("_k", seed) % F.col("_c"))  # one row a class
    rows = shuffled(df, [label], id_, seed, "_n").select(label, "_n", id_)
    return draws.join(rows, [label, "_n"]).select("batch", label, "slot", id_)


def weighted_batches(df: DataFrame, label: str, id_: str, size: int, seed: int = 42) -> DataFrame:
    """(batch, slot, id): draws with replacement by inverse class size, ``size`` to a batch, as many as rows."""
    weights = class_weights(df, label).select(label, F.col("balanced").alias("_w"))
    rows = df.join(weights, label)
    n = -(-df.count() // size) * size
    drawn = weighted_draws(rows, id_, "_w", n, seed)
    return drawn.select(F.floor(F.col("draw") / size).alias("batch"), (F.col("draw") % size).alias("slot"), id_)
