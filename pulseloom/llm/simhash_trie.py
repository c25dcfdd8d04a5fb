"""SimHash near-duplicates by a self-join of a binary trie.

A fingerprint takes a majority vote, bit by bit, over the XXH64 values of a text's
word shingles. Distinct fingerprints, as a sorted array, are a binary trie: a node
of depth d is a range of values that share d leading bits. The join walks pairs of
nodes together, adds up the bits in which their prefixes differ, and drops a pair as
soon as the sum exceeds the error budget.

With a budget of e bits the fingerprint is cut into e + 1 blocks, of which any pair within
the budget shares one. So there are e + 1 tries, one for each rotation that puts a block in
front; their nodes at the depth of that block are joined by executors, each with itself. A pair
counts in the first rotation that brings it together. Nothing of the tries reaches
the driver, and a fingerprint is sent e + 1 times whatever their number. Nodes with more rows
than a task should hold are cut into tiles, and pairs of tiles are walked instead. Equal
fingerprints are one class, so copies are never expanded into pairs; inside a node links are
reduced to a spanning forest and to counts before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.components import connected_components
from pulseloom.llm.store import stored

SEED = 42


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text: zero for null and wordless texts."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest, seed = xxhash.xxh64_intdigest, SEED
    spans = zip(starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())
    hashes = np.fromiter((digest(line[s:e], seed) for s, e in spans), np.uint64, len(tokens) - words + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype(">u8"))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, fp)``; fp is the unsigned value kept in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([text_fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def blocks(errors: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of each block."""
    edges = [64 * k // (errors + 1) for k in range(errors + 2)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def trie_join(a: np.ndarray, b: np.ndarray | None, errors: int, chunk: int = 1 << 18, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with Hamming distance 1 to ``errors`` between sorted, distinct arrays ``a`` and ``b`` (``None``: within ``a``, each pair once); all values share their first ``depth`` bits."""
    own = b is None
    b = a if own else b
    stack = [(depth, np.array([[0, len(a), 0, len(b), 0]], np.int64))] if len(a) and len(b) else []
    one = np.uint64(1)
    while stack:
        depth, pairs = stack.pop()
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16
        if depth == 64:
            small[:] = True
        if small.any():
            p = pairs[small]
            wide = p[:, 3] - p[:, 2]
            total = (p[:, 1] - p[:, 0]) * wide
            row = np.repeat(np.arange(len(p)), total)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
            i, j = p[row, 0] + nth // wide[row], p[row, 2] + nth % wide[row]
            ok = np.bitwise_count(a[i] ^ b[j]) <= errors
            ok &= (i < j) if own else (a[i] != b[j])
            if ok.any():
                yield i[ok], j[ok]
        pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = np.uint64(63 - depth)

        def middle(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            start = (values[low] >> bit) >> one << one
            return np.clip(np.searchsorted(values, (start + one) << bit), low, high)

        ma, mb = middle(a, pairs[:, 0], pairs[:, 1]), middle(b, pairs[:, 2], pairs[:, 3])
        kids = []
        for x in (0, 1):
            for y in (0, 1):
                if own and (x, y) == (1, 0):
                    mirrored = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
                else:
                    mirrored = np.zeros(len(pairs), bool)
                kid = np.stack([ma if x else pairs[:, 0], pairs[:, 1] if x else ma, mb if y else pairs[:, 2], pairs[:, 3] if y else mb, pairs[:, 4] + (x != y)], axis=1)
                kids.append(kid[(kid[:, 0] < kid[:, 1]) & (kid[:, 2] < kid[:, 3]) & (kid[:, 4] <= errors) & ~mirrored])
        kids = np.concatenate(kids)
        stack += [(depth + 1, kids[at : at + chunk]) for at in range(0, len(kids), chunk)]


class Forest:
    """Union-find over array positions that takes links in blocks."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            y = up[x]
            if (y == x).all():
                return x
            up[x] = up[y]
            x = up[x]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.root(i.copy()), self.root(j.copy())
        while (i != j).any():
            keep = i != j
            low, high = np.minimum(i[keep], j[keep]), np.maximum(i[keep], j[keep])
            np.minimum.at(self.up, high, low)
            i, j = self.root(low), self.root(high)


def _join_node(fp: np.ndarray, size: np.ndarray, first: int, errors: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with links, their roots, their links) of one node's rotated fingerprints; of ``first`` with the rest if there is a rest."""
    cut = blocks(errors)
    begin, width = cut[turn]
    links, forest = np.zeros(len(fp), np.int64), Forest(len(fp))
    second = fp[first:] if first < len(fp) else None
    for i, j in trie_join(fp[:first], second, errors, depth=width):
        j = j + (0 if second is None else first)
        new = np.ones(len(i), bool)
        differ = fp[i] ^ fp[j]
        for low, wide in cut[:turn]:  # an earlier rotation that brings them together counts the pair
            behind = np.uint64(64 - (low - begin) % 64 - wide)
            new &= (differ >> behind & np.uint64((1 << wide) - 1)) != 0
        i, j = i[new], j[new]
        links += np.bincount(i, size[j], len(fp)).astype(np.int64) + np.bincount(j, size[i], len(fp)).astype(np.int64)
        forest.link(i, j)
    got = np.flatnonzero(links)
    return got, forest.root(got), links[got]


def _join_nodes(errors: int):
    """Rows sorted by node to links; a node that continues in the next batch waits for it."""
    place = ["turn", "node", "low", "high"]

    def joined(rows: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
        fp, size = rows["value"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
        tile, low, turn = (rows[c].to_numpy() for c in ("tile", "low", "turn"))
        found = []
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if stop - start > 1:
                first = int((tile[start:stop] == low[start]).sum())
                at, root, links = _join_node(fp[start:stop], size[start:stop], first, errors, int(turn[start]))
                if len(at):
                    found.append((start + at, start + root, links))
        if not found:
            return pd.DataFrame({"fp": [], "root": [], "links": []}, dtype="int64")
        at, root, links = (np.concatenate(x) for x in zip(*found))
        back = np.array([low for low, _ in blocks(errors)], np.uint64)[turn[at]]  # rotations keep to a node
        turned = lambda v: (v >> back | v << (np.uint64(64) - back) % np.uint64(64)) if len(v) else v
        return pd.DataFrame({"fp": turned(fp[at]).view(np.int64), "root": turned(fp[root]).view(np.int64), "links": links})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch) == 0:
                continue
            rows = pd.concat([*held, batch], ignore_index=True)
            key = rows[place].to_numpy()
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1))
            yield joined(rows, edges)
            held = [rows.iloc[edges[-1] :]]
        if held:
            yield joined(held[0], np.array([0, len(held[0])]))

    return run


def near_classes(prints: DataFrame, errors: int = 2, node_rows: int = 50_000) -> DataFrame:
    """``(doc_id, fp)`` to ``(fp, n, links, least, root, component_id)`` for each distinct fingerprint.

    links: documents of other fingerprints within ``errors`` bits. component_id: the
    smallest doc_id reachable. A task holds the fingerprints of one node at a time, or two tiles of
    at most about ``node_rows`` each.
    """
    classes = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "fingerprints")
    turned = [F.struct(F.lit(k).alias("turn"), F.shiftrightunsigned(v, 64 - wide).alias("node"), v.alias("value")) for k, (low, wide) in enumerate(blocks(errors)) for v in [_rotated(low)]]
    rows = classes.select("n", F.explode(F.array(*turned)).alias("r")).select("n", "r.*")
    counts = rows.groupBy("turn", "node").agg(F.count("*").alias("rows")).where("rows > 1")
    counts = stored(counts.withColumn("tiles", F.when(F.col("rows") > 2 * node_rows, F.ceil(F.col("rows") / node_rows)).otherwise(1).cast("int")), "nodes")
    rows = rows.join(counts.select("turn", "node", "tiles"), ["turn", "node"])
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("value", F.lit("tile")), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("turn", "node", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "value", "n")
    dealt = rows.repartition("turn", "node", "low", "high").sortWithinPartitions("turn", "node", "low", "high", "tile", F.expr(_UNSIGNED))
    found = stored(dealt.mapInPandas(_join_nodes(errors), "fp long, root long, links long"), "links")
    roots = connected_components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("fp").agg(F.sum("links").alias("links"))
    named = stored(classes.join(linked, "fp", "left").join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), "root"), "classes")
    # stored, so that its true size decides how it is joined to a component that holds a large share of the rows
    least = stored(named.where("root is not null").groupBy("root").agg(F.min("least").alias("of_root")), "components")
    return named.join(least, "root", "left").select("fp", "n", "links", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("of_root", "least").alias("component_id"))


def _rotated(low: int) -> Column:
    """The fingerprint with its bit ``low`` (from the top) in front."""
    return F.col("fp") if low == 0 else F.shiftleft("fp", low).bitwiseOR(F.shiftrightunsigned("fp", 64 - low))


#: Orders signed longs as the unsigned values that they hold.
_UNSIGNED = "value ^ shiftleft(1L, 63)"


def simhash_components(docs: DataFrame, words: int = 3, errors: int = 2, node_rows: int = 50_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_links, kept.

    Null and wordless texts have fingerprint zero and link like any other. Repeated
    rows of one doc_id are documents of their own in n_links and share a component.
    kept marks the document whose id names the component. Other columns are ignored;
    an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, words), "prints")
    classes = near_classes(prints, errors, node_rows)
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("links") + F.col("n") - 1).alias("n_links"),
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
