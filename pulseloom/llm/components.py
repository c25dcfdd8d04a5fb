"""Connected components by randomised contraction, entirely in DataFrames.

Each round every vertex moves to the neighbour (or itself) of least keyed hash and
the edges are rewritten between the new names. A hash order that changes with the
round shrinks the graph by a constant factor whatever its shape, so paths and hubs
take a logarithmic number of rounds. No list of neighbours is ever gathered, minima
are pre-aggregated before the shuffle, and every round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.store import stored


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` of longs to ``(id, root)``: one row per vertex of some edge, where
    vertices of one component share a root. Loops and null ends link nothing and give no rows; repeated edges count once;
    no edges give an empty table. The root is any vertex of the component."""
    spark = edges.sparkSession
    left = edges.select("a", "b").where("a <> b").distinct()
    steps: list[DataFrame] = []
    left = stored(left, "edges")
    while not left.isEmpty():
        if len(steps) == max_rounds:
            raise RuntimeError("contraction did not end")
        key = F.lit(len(steps))
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("to")))
        rank = lambda c: F.struct(F.xxhash64(c, key).alias("h"), F.col(c).alias("v"))
        best = ends.groupBy("id").agg(F.min(rank("to")).alias("best"))
        move = stored(best.select("id", F.least(F.col("best"), rank("id"))["v"].alias("to")), "moves")
        steps.append(move)
        on_a = move.select(F.col("id").alias("a"), F.col("to").alias("a2"))
        on_b = move.select(F.col("id").alias("b"), F.col("to").alias("b2"))
        left = stored(left.join(on_a, "a").join(on_b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
    if not steps:
        return spark.createDataFrame([], "id long, root long")
    roots = steps[0].select("id", F.col("to").alias("root"))
    for move in steps[1:]:
        moved = move.select(F.col("id").alias("root"), F.col("to").alias("next"))
        roots = roots.join(moved, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return roots
