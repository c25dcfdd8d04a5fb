"""Embedding near-duplicates by a forest of random-projection trees.

Every tree sends a vector down by the side of a threshold on which its projection lies.
A tree's directions are drawn from a seed, one for each level. Trees grow in rounds of a few
levels: every node with more rows than a leaf may hold is sampled, a worker fits the
thresholds (medians) of its next levels, and all its rows go down by them. So leaves stay
small however many rows there are, the driver holds nothing that grows with the
table or its labels, and a fit sees a bounded sample of one node. A vector that lies close to a
threshold spills over: it goes to both sides, so that near pairs seldom part. How close is a
share of what the projections of a pair at the wanted cosine differ by, which shrinks with the
dimension as projections do. A node of which more than three tenths would spill is a crowd of
near vectors and isn't split. Vectors that meet in a leaf are compared in double precision.

A pair that meets in several leaves counts once: each row carries its leaves, and the
pair belongs to the first one that the two share. A leaf's links therefore become
counts and a spanning forest before they leave the task. Leaves that can't be split further
(crowds) are compared tile by tile in several tasks, so a crowd
of near copies is neither cut nor gathered in one. Equal vectors of a label are one
class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.components import connected_components
from pulseloom.llm.simhash_trie import Forest
from pulseloom.llm.store import stored

#: Levels that a round adds, and the most rounds: 48 levels.
LEVELS, ROUNDS = 4, 12
#: Sampled rows by which a node's next levels are fitted.
SAMPLE = 1024


def directions(seed: int, trees: int, first: int, size: int) -> np.ndarray:
    """Unit directions of a round's levels, tree after tree."""
    found = np.stack([np.random.default_rng([seed, t, first + d]).standard_normal(size) for t in range(trees) for d in range(LEVELS)])
    return found / np.linalg.norm(found, axis=1, keepdims=True)


#: Largest share of a node's rows that may spill.
MOST_SPILL = 0.3


def fit_node(heights: np.ndarray, depth: int, band: float) -> np.ndarray:
    """Thresholds for ``depth`` levels below a node, in heap order, from rows of projections by level.

    A threshold that too many rows lie close to is minus infinity: all rows go on together. None at all if that holds for the node itself.
    """
    cuts = np.full(2**depth - 1, -np.inf)
    node = np.zeros(len(heights), np.int64)
    for d in range(depth):
        h = heights[:, d]
        for k in range(2**d):
            mine = h[node == k]
            if len(mine):
                cut = np.median(mine)
                if (np.abs(mine - cut) < band).mean() <= MOST_SPILL:
                    cuts[2**d - 1 + k] = cut
        node = 2 * node + (h >= cuts[2**d - 1 + node])
    return cuts if depth and np.isfinite(cuts[0]) else cuts[:0]


def _children() -> Column:
    """Heap numbers (1 is the node itself) of the places that a row with heights ``h`` reaches by ``cuts`` and ``band``."""
    step = "x * 2 + side"
    inside = "CASE side WHEN 0 THEN h[{d}] - cuts[x - 1] < band ELSE h[{d}] - cuts[x - 1] >= -band END"
    places = "array(1L)"
    for d in range(LEVELS):
        down = f"flatten(transform({places}, x -> transform(filter(array(0L, 1L), side -> {inside.format(d=d)}), side -> {step})))"
        places = f"CASE WHEN size(cuts) >= {2 ** (d + 1) - 1} THEN {down} ELSE {places} END"
    return F.expr(places)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near one: no digit changes, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(values: list) -> np.ndarray:
    x = scaled(np.array(values, np.float64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(threshold: float):
    """Counts and spanning forest of one leaf, or of one pair of its tiles."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tile", "rep"], kind="stable")
        rep, copies, tile = rows["rep"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), rows["tile"].to_numpy()
        raw = scaled(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        norm = np.linalg.norm(raw, axis=1)
        low, high, leaf = map(int, key[1:])
        places = rows["leaves"].tolist()
        first = np.flatnonzero(tile == low)
        second = first if low == high else np.flatnonzero(tile == high)
        links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        for at in range(0, len(first), 512):
            i = first[at : at + 512]
            near = (raw[i] @ raw[second].T) / (norm[i][:, None] * norm[second][None]) >= threshold
            a, b = np.nonzero(near)
            a, b = i[a], second[b]
            if low == high:
                keep = a < b
                a, b = a[keep], b[keep]
            if len(a):
                mine = _first_meeting(places, a, b, leaf)
                a, b = a[mine], b[mine]
            links += np.bincount(a, copies[b], len(rep)).astype(np.int64) + np.bincount(b, copies[a], len(rep)).astype(np.int64)
            forest.link(a, b)
        got = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[got], "root": rep[forest.root(got)], "links": links[got]})

    return run


def _first_meeting(places: list[np.ndarray], a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether ``leaf`` is the first of the places where both rows are."""
    used = np.unique(np.concatenate([a, b]))
    before = [x[x < leaf] for x in (np.asarray(places[k]) for k in used)]
    every, place = np.unique(np.concatenate(before), return_inverse=True) if before else (np.empty(0), np.empty(0))
    if not len(every):
        return np.ones(len(a), bool)
    member = np.zeros((len(used), (len(every) + 7) // 8 * 8), np.uint8)
    member[np.repeat(np.arange(len(used)), [len(x) for x in before]), place] = 1
    bits = np.packbits(member, axis=1)
    where_a, where_b = np.searchsorted(used, a), np.searchsorted(used, b)
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        s = slice(at, at + (1 << 15))
        out[s] = ~(bits[where_a[s]] & bits[where_b[s]]).any(axis=1)
    return out


def grow(classes: DataFrame, trees: int, leaf_rows: int, reach: float, seed: int) -> DataFrame:
    """``(label, rep, leaf)``: the leaves of every row of ``classes(rep, label, embedding)`` in all trees. A leaf's number holds its tree in the top byte and its path below a leading one. ``reach``: half width of the band that spills, times the square root of the dimension."""
    at = classes.select("label", "rep", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(None).cast("long").alias("was"))
    found: DataFrame | None = None
    for turn in range(ROUNDS):
        counts = at.groupBy("label", "tree", "node").agg(F.count("*").alias("rows"), F.max("was").alias("was"))
        # a node that its last round hardly parted stays a leaf
        counts = stored(counts.where((F.col("rows") > leaf_rows) & (F.col("was").isNull() | (F.col("rows") <= 0.9 * F.col("was")))).drop("was"), "crowded")
        done = at.join(counts, ["label", "tree", "node"], "left_anti")
        found = done if found is None else found.unionByName(done)
        if counts.isEmpty():
            break

        def project(batches: Iterator[pd.DataFrame], first: int = turn * LEVELS) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, part in batch.groupby(batch["embedding"].map(len)):
                    heights = _unit(part["embedding"].tolist()) @ directions(seed, trees, first, len(part["embedding"].iloc[0])).T
                    yield pd.DataFrame({"rep": part["rep"].to_numpy(), "band": reach / np.sqrt(len(part["embedding"].iloc[0])), "heights": list(heights)})

        def fit(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("rep")
            depth = min(LEVELS, int(np.ceil(np.log2(rows["rows"].iloc[0] / leaf_rows))))
            cuts = fit_node(np.stack(rows["h"].tolist()), depth, rows["band"].iloc[0])
            return rows.iloc[:1][["label", "tree", "node"]].assign(cuts=[cuts])

        heights = classes.select("rep", "embedding").mapInPandas(project, "rep long, band double, heights array<double>")
        rows = at.drop("was").join(counts, ["label", "tree", "node"]).join(heights, "rep")
        rows = stored(rows.select("label", "tree", "node", "rep", "rows", "band", F.slice("heights", F.col("tree") * LEVELS + 1, LEVELS).alias("h")), "heights")
        drawn = F.pmod(F.xxhash64("rep", F.lit(seed), "tree", F.lit(turn)), F.lit(2**31)) / F.lit(2.0**31) * F.col("rows") < SAMPLE
        fits = rows.where(drawn).groupBy("label", "tree", "node").applyInPandas(fit, "label string, tree int, node long, cuts array<double>")
        fits = stored(fits, "thresholds")
        down = rows.join(fits, ["label", "tree", "node"]).select("label", "rep", "tree", "node", F.col("rows").alias("was"), F.explode(_children()).alias("x"))
        power = F.expr("shiftleft(1L, length(bin(x)) - 1)")
        at = stored(down.select("label", "rep", "tree", (F.col("node") * power + F.col("x") - power).alias("node"), "was"), "placed")
    else:
        found = found.unionByName(at)
    return found.select("label", "rep", (F.shiftleft(F.col("tree").cast("long"), 56) + F.col("node")).alias("leaf"))


def forest_components(vectors: DataFrame, threshold: float = 0.93, trees: int = 6, leaf_rows: int = 256, spill: float = 0.45, tile_rows: int = 1024, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors(vec_id, embedding, label)``.

    Pairs of one label with cosine >= ``threshold`` that meet in some leaf are linked. Rows
    with a null label, or a vector that is null, empty, zero or holds null or non-finite
    components, link with nothing. Vectors of one label but of different lengths don't link: each (label, length) has
    a forest of its own. Repeated rows of one vec_id are vectors of their own; a null id names no
    component, and a component of null ids has none. Other columns are ignored. An empty table gives no rows.
    """
    kind = "array<double>" if dict(vectors.dtypes)["embedding"] == "array<double>" else "array<float>"
    every = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    sized = F.concat_ws(":", F.size("embedding"), "label")  # from here a label means one label and length
    every = stored(every.withColumns({"ok": F.coalesce(usable, F.lit(False)), "label": F.when(usable, sized)}), "vectors")
    good = every.where("ok").select("vec_id", "embedding", "label")  # Spark groups and joins -0 as 0
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("rep", F.xxhash64("label", "embedding")), "classes")  # 64 bits name a class: ids may be null or repeated
    reach = spill * float(np.sqrt(2 - 2 * threshold))  # pairs at the threshold lie that square root apart
    leaves = stored(grow(classes, trees, leaf_rows, reach, seed), "leaves")
    crowded = leaves.groupBy("label", "leaf").count().where(F.col("count") > 2 * tile_rows)
    tiles = stored(crowded.select("label", "leaf", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")), "tiles")
    mine = leaves.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))  # as many as trees and spilling make
    spots = classes.drop("least").join(mine, "rep").select("label", "rep", "copies", "embedding", "leaves", F.explode("leaves").alias("leaf"))
    spots = spots.join(tiles, ["label", "leaf"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    spots = spots.withColumn("tile", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spots = spots.withColumn("other", other).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    met = spots.groupBy("label", "low", "high", "leaf").applyInPandas(_compare(threshold), "rep long, root long, links long")
    met = stored(met, "links")
    roots = connected_components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = stored(classes.select("rep", "least").join(links, "rep").join(roots.withColumnRenamed("id", "rep"), "rep"), "linked")
    # stored, so that its true size decides how it is joined to a component that holds a large share of the rows
    components = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    linked = linked.join(components, "root").select("rep", "links", "component_id")
    named = classes.join(linked, "rep", "left").select("label", F.col("embedding").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = every.withColumn("key", F.when(F.col("ok"), F.col("embedding"))).join(named, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
