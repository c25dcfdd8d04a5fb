"""Near-duplicates by the Jaccard similarity of word-shingle sets.

Texts with the same set of shingles are one class. Candidates come from two searches. The
first is the trie self-join of SimHash fingerprints over the same shingles: a group of
fingerprints linked within two bits is one of candidates. Sets of similarity 0.8 mostly differ
in more bits than a trie can be walked for (ten of 64 are to be expected), so the second search
finds the rest: a class has a signature of least hashes, one for each bin of the hashes
(one-permutation hashing; an empty bin takes the value of another by a fixed draw), cut into bands,
and classes that share a band are candidates. Every link is verified by the exact sets.

A group is done with when all its members are connected, whatever connects them:

1. Groups with the same members are one. Each member is compared with the group's leader, the member of least hash, which is mostly the
   same one in all groups of near copies, so few pairs are compared. Large groups have a leader for each few thousand members, all led by one.
2. Groups whose members are still in several components go to tasks with the members' signatures, a byte for each bin. Members whose signature agrees with that of
   no member of another component in about as many bins as similar sets would (less five standard deviations) leave the group: texts that share
   a frequent passage part here. Groups too large for one task are met tile by tile, and only what lies outside the group's largest
   component with everything else.
3. Members that are left go to tasks with their sets, where a prefix filter (sets of similarity s share one of their rarest 1 - s) finds the pairs
   to compare, and what is connected isn't compared again.

The number of steps doesn't depend on any group's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm import simhash_trie
from pulseloom.llm.components import connected_components
from pulseloom.llm.store import stored

SEED = 42
BANDS, ROWS = 25, 5
#: Members of a group that one task compares, and members that share a leader.
SMALL, SEAT = 512, 4096


def all_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of a text's word shingles in order: one of the whole line for short texts, none for null and wordless ones."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest, seed = xxhash.xxh64_intdigest, SEED
    spans = zip(starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())
    return np.fromiter((digest(line[s:e], seed) for s, e in spans), np.uint64, len(tokens) - words + 1)


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(all_hashes(text, words))


@lru_cache(maxsize=1)
def _draws() -> np.ndarray:
    """For each bin, all bins in a drawn order."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BANDS * ROWS) for _ in range(BANDS * ROWS)])


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """A set's signature: the least mixed hash of each bin; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    bins = ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(BANDS * ROWS) >> np.uint64(32)
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bins.astype(np.int64), mixed)
    held = np.zeros(BANDS * ROWS, bool)
    held[bins.astype(np.int64)] = True
    if not held.all():
        draws = _draws()
        least = least[np.take_along_axis(draws, held[draws].argmax(1)[:, None], 1)[:, 0]] * ~held + least * held
    return least


def bands_of(least: np.ndarray) -> list[int]:
    """The bands of least hashes."""
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - 2**63 for k, band in enumerate(least.reshape(-1, ROWS))]


def signature(least: np.ndarray) -> bytes:
    """A byte for each of the least hashes, mixed."""
    return ((least ^ (least >> np.uint64(23))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8).tobytes()


def agreement(size: np.ndarray, least: float) -> np.ndarray:
    """The share of bins in which signatures of similar sets agree, less five standard deviations, by the size of the smaller set. Small sets fill few bins."""
    bins = BANDS * ROWS
    filled = np.maximum(bins * -np.expm1(-size / bins), 1)
    return least - 5 * np.sqrt(least * (1 - least) / filled)


def may_link(signatures: np.ndarray, sizes: np.ndarray, roots: np.ndarray, least: float) -> np.ndarray:
    """Which members may be similar to a member of another component."""
    found = np.zeros(len(roots), bool)
    if not signatures.size:
        return found
    for k in range(len(roots)):
        other = np.flatnonzero((roots[k + 1 :] != roots[k]) & (np.minimum(sizes[k + 1 :], sizes[k]) >= least * np.maximum(sizes[k + 1 :], sizes[k]) - 1e-9)) + k + 1
        if len(other):
            near = other[(signatures[other] == signatures[k]).mean(1) >= agreement(np.minimum(sizes[other], sizes[k]), least)]
            if len(near):
                found[k] = True
                found[near] = True
    return found


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` with whether their sets, ``(key, hashes)``, are similar."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b):
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(found, dtype=bool)

    left, right = (sets.select(F.col("key").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", similar("of_a", "of_b").alias("ok"))


def similar_pairs(classes: DataFrame, words: int, least: float) -> DataFrame:
    """Links ``(a, b)`` between keys of ``classes(key, text, fp, bands, sig, n)`` whose sets have at least that similarity: those that connect all
    candidates that such links connect, not every one."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, words).view(np.int64) for t in texts])

    prints = classes.select(F.col("key").alias("doc_id"), "fp")
    linked = simhash_trie.near_classes(prints).select("fp", "root")
    walked = prints.join(linked, "fp").select(F.col("doc_id").alias("key"), F.xxhash64(F.lit(-1), "root").alias("g"))
    banded = classes.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("g"))
    spots = stored(walked.unionByName(banded), "spots")
    shared = spots.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    members = stored(spots.join(shared, "g"), "members")
    sets = stored(classes.join(members.select("key").distinct(), "key", "left_semi").select("key", hashes("text").alias("hashes")), "sets")
    links, open_ = _connected(members, sets, least)
    return stored(links.unionByName(_in_tasks(open_, classes.select("key", "n", "sig"), sets, least)), "links")


def _once(groups: DataFrame) -> DataFrame:
    """``groups(g, key, ...)`` without those that have one member or the same members as another."""
    own = groups.groupBy("g").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(2**31))).alias("s")).where("n > 1")
    one = own.groupBy("n", "x", "s").agg(F.min("g").alias("g")).select("g", "n")
    return groups.join(one, "g")


def _connected(members: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, members (g, key, root, n) of the groups that they don't connect) after every member of ``members(g, key)`` was compared with its group's leader."""
    members = stored(_once(members), "groups")
    first = lambda: F.min_by("key", F.struct(F.xxhash64("key"), "key"))
    seat = F.pmod(F.xxhash64(F.lit(9), "key"), F.ceil(F.col("n") / SEAT)).alias("seat")
    seated = members.select("g", "key", seat)
    leaders = stored(seated.groupBy("g", "seat").agg(first().alias("leader")), "leaders")
    heads = leaders.select("g", F.col("leader").alias("key")).groupBy("g").agg(first().alias("leader"))
    pairs = seated.join(leaders, ["g", "seat"]).select("key", "leader").unionByName(leaders.select("g", F.col("leader").alias("key")).join(heads, "g").select("key", "leader"))
    pairs = pairs.where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    links = stored(_verify(pairs, sets, least).where("ok").select("a", "b"), "links")
    roots = connected_components(links).withColumnRenamed("id", "key")
    named = members.join(roots, "key", "left").select("g", "key", F.coalesce("root", "key").alias("root"), "n")
    several = named.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g")
    return links, stored(named.join(several, "g"), "open")


def links_among(keys: Sequence[int], roots: Sequence[int], sets: Sequence[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Similar pairs that connect what the roots don't connect yet: a forest over the given sets. Every set is compared with all smaller ones that share a rare shingle with it."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(x) for x in sets])
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    each = np.split(codes, np.cumsum(sizes)[:-1])
    holders: dict[int, list[int]] = {}
    found = []
    for k in np.argsort(sizes, kind="stable").tolist():
        own = each[k]
        rare = own[np.lexsort((own, counts[own]))][: len(own) - int(np.ceil(len(own) * least - 1e-9)) + 1]
        near: dict[int, None] = {}
        for code in rare[counts[rare] > 1].tolist():
            near.update(dict.fromkeys(holders.get(code, ())))
            holders.setdefault(code, []).append(k)
        for other in near:
            if sizes[other] >= least * sizes[k] - 1e-9 and top(roots[other]) != top(roots[k]):
                both = len(np.intersect1d(each[other], own, assume_unique=True))
                if both >= least * (sizes[other] + sizes[k] - both) - 1e-9:
                    parent[top(roots[other])] = top(roots[k])
                    found.append((min(keys[k], keys[other]), max(keys[k], keys[other])))
    return found


def _in_tasks(open_: DataFrame, signed: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links among ``open_(g, key, root, n)``. Members outside their group's largest component meet all others, in tiles where there are more than ``SMALL``."""
    sized = open_.groupBy("g", "root").agg(F.count("*").alias("m"))
    main = sized.groupBy("g").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("inside"))
    rows = open_.join(main, "g").withColumnRenamed("n", "total")
    tile = lambda total: F.greatest(F.ceil(total / (SMALL / 2)), F.lit(1)).cast("int")
    outer = tile(F.col("total") - F.col("inside"))
    inner, mine = tile(F.col("inside")), lambda count: F.pmod(F.xxhash64(F.lit(3), "key"), count).cast("int")
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    unit = lambda i, kind, j: F.struct(i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"))
    strays = F.concat(F.transform(upto(outer), lambda j: unit(F.least(mine(outer), j), 0, F.greatest(mine(outer), j))), F.transform(upto(inner), lambda j: unit(mine(outer), 1, j)))
    held = F.transform(upto(outer), lambda i: unit(i, 1, mine(inner)))
    where = F.when(F.col("total") <= SMALL, F.array(unit(F.lit(0), 0, F.lit(0)))).when(F.col("root") == F.col("main"), held).otherwise(strays)
    placed = rows.select("key", "root", "g", F.explode(where).alias("unit")).withColumn("g", F.xxhash64("g", "unit")).drop("unit").join(signed, "key")

    def sift(unit: pa.Table) -> pa.Table:
        roots = unit.column("root").to_numpy()
        joined = b"".join(unit.column("sig").to_pylist())
        signatures = np.frombuffer(joined, np.uint8).reshape(len(roots), -1) if len(joined) == len(roots) * BANDS * ROWS else np.empty((len(roots), 0), np.uint8)
        return unit.select(["g", "key", "root"]).filter(pa.array(may_link(signatures, unit.column("n").to_numpy(), roots, least)))

    left = stored(placed.groupBy("g").applyInArrow(lambda t: sift(t), "g long, key long, root long"), "sifted")

    def run(unit: pa.Table) -> pa.Table:
        hashes = [x.values.to_numpy() for x in unit.column("hashes")]
        found = links_among(unit.column("key").to_pylist(), unit.column("root").to_pylist(), hashes, least)
        return pa.table({c: pa.array([p[k] for p in found], pa.int64()) for k, c in enumerate("ab")})

    return _once(left).select("g", "key", "root").join(sets, "key").groupBy("g").applyInArrow(lambda t: run(t), "a long, b long")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay when one of each group of similar documents is kept.

    The document with the least id stays; null ids come last, and of equal ids the text of least hash; rows alike in both are
    alike for this. Null and wordless texts are one class. Copies are reduced before the shuffle, so a hot group moves one row a task.
    """

    @F.pandas_udf("key long, fp long, bands array<long>, sig binary, n int")
    def signed(texts: pd.Series) -> pd.DataFrame:
        """The set's hash, fingerprint, bands, signature and size, from one pass over a text's shingles."""
        rows = []
        for text in texts:
            every = all_hashes(text, words)
            own = np.unique(every)
            fp = np.array([simhash_trie.majority(every)], np.uint64).view(np.int64)[0]
            low = least_hashes(own)
            rows.append((xxhash.xxh64_intdigest(own.tobytes(), SEED) - 2**63, fp, bands_of(low), signature(low), len(own)))
        return pd.DataFrame(rows, columns=["key", "fp", "bands", "sig", "n"])

    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("doc"), signed(F.col("text").cast("string")).alias("s"))
    number = F.col("doc.doc_id").cast("long")
    order = F.struct(number.isNull().alias("none"), number.alias("id"), F.xxhash64(F.col("doc.text").cast("string")).alias("tie"))
    first = named.groupBy("s.key").agg(F.min_by(F.struct("doc", order.alias("rank"), "s.fp", "s.bands", "s.sig", "s.n"), order).alias("k"))
    first = stored(first.select("key", "k.*"), "classes")
    links = similar_pairs(first.select("key", F.col("doc.text").cast("string").alias("text"), "fp", "bands", "sig", "n"), words, least)
    roots = stored(connected_components(links).withColumnRenamed("id", "key"), "roots")
    # only ids and hashes of linked classes meet here; documents are met by the classes that go, which are few
    linked = first.select("key", F.struct("rank", "key").alias("rank")).join(roots, "key")
    staying = linked.groupBy("root").agg(F.min_by("key", "rank").alias("key")).select("key")
    going = stored(linked.select("key").join(staying, "key", "left_anti"), "going")
    return first.join(going, "key", "left_anti").select("doc.*")
