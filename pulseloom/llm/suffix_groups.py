"""Repeated passages by suffix trees over groups of suffixes that share a prefix.

A suffix begins at every word that has a whole window (50 words) after it. Its prefix has a variable length: it
ends with the run of ``GRAM`` words, among those that begin early enough to lie within the window, whose hash is least. Suffixes whose
prefixes end in the same run of words form a group. Which run that is depends on the window's words alone, so equal windows are in
one group; and neighbouring suffixes mostly end in the same run, so they travel together as one piece of text instead of
a window each.

1. A census of the runs gives those that occur under two different ids. No window of any other is repeated, and
   nothing of theirs goes further.
2. The pieces of the runs that are left are cut from their documents. Equal pieces become one, with their least and largest id, before
   and after the shuffle, so copies cost one piece however many there are.
3. Groups are packed into bins of the size of a task's memory. A bin's suffixes are sorted by prefix doubling with their common
   prefix lengths, which is their suffix tree: neighbours that share a window's length lie below one deep internal node, a maximal
   repeat, whose least id goes to every suffix below it.
4. A run of words with more than ``MOST`` different pieces (a frequent line in ever new surroundings) would outgrow a bin. The prefixes of its
   suffixes are lengthened to the whole window, where a prefix is itself a deep node, and counted by Spark.
5. A window goes if its node's least id is smaller than its document's; the words it covers are put together by document.

Nothing is dropped or sampled. Words are compared as they are in a bin; pieces and long prefixes are told apart by 128 bits, documents by
two hashes of 64 bits of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.store import stored

WINDOW, GRAM = 50, 16
#: Different pieces of one run of words that a bin takes, words in a bin, suffixes in a piece.
MOST, BIN_WORDS, LONGEST = 4096, 400_000, 1024
LAST = 2**63 - 1
#: An odd multiplier, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1


class Vocabulary(dict):
    """Hashes of the words met so far; emptied when it holds a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse."""
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def pieces_of(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first suffixes, numbers of suffixes, group keys): stretches of suffixes whose prefixes end in the same run of words."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(1 << max(12, (n - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n])])
    least = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]  # a run's hash, wherever it stands
    least = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least ^= least >> np.uint64(32)
    wide, want = 1, window - gram + 1
    while wide < want:  # minima over 1, 2, 4 ... and at last all places
        step = min(wide, want - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    cuts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
    lengths = np.diff(cuts)
    if lengths.max() > LONGEST:
        cuts = np.concatenate([*[np.arange(a, b, LONGEST) for a, b in zip(cuts[:-1], cuts[1:])], [len(least)]])
        lengths = np.diff(cuts)
    return cuts[:-1], lengths, least[cuts[:-1]].view(np.int64)


def sorted_suffixes(codes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes at ``starts`` in the order of their first ``window`` codes, and of how many
    codes each shares with the one before it (0 for the first). Every suffix must have a window of codes."""
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
    wide = 1
    while 2 * wide <= window:  # ranks by 1, 2, 4 ... codes; places too near the end have no rank and aren't used
        rank = ranks[-1]
        pair = rank[:-wide] * np.int64(int(rank.max(initial=0)) + 1) + rank[wide:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        wide *= 2
    top = ranks[-1]
    order = np.lexsort((top[starts + window - wide], top[starts]))
    a, b = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        size = 1 << k
        fits = common + size <= window
        same = fits & (ranks[k][np.where(fits, a + common, 0)] == ranks[k][np.where(fits, b + common, 0)])
        common += np.where(same, size, 0)
    return order, np.concatenate([[0], common])[: len(starts)]


def least_below(order: np.ndarray, common: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each suffix the least id below the deep internal node that it hangs from (its own where there is none)."""
    if not len(order):
        return ids
    first = np.flatnonzero(common < window)
    least = np.minimum.reduceat(ids[order], first)
    out = np.empty_like(ids)
    out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def document_key(id_: str = "doc_id", text: str = "text") -> list[Column]:
    """Two hashes that tell documents apart; rows alike in id and text are one document."""
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit(1), text, id_).alias("k2")]


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text, k1, k2): doc is the id as a long that null ids follow."""
    named = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return named.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text", *document_key())


def _words(column: pa.Array) -> Iterator[list[bytes]]:
    for text in column.cast(pa.binary()):
        value = text.as_py()
        yield value.split() if value else []  # bytes are split at the six ASCII blanks and at nothing else


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, k1, k2, h): each document's group keys, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            at, keys = [], []
            for k, words in enumerate(_words(batch.column(3))):
                own = np.unique(pieces_of(vocabulary.of(words), window, gram)[2])
                at.append(np.full(len(own), k))
                keys.append(own)
            rows = pa.array(np.concatenate([np.empty(0, np.int64), *at]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in range(3)], pa.array(np.concatenate([np.empty(0, np.int64), *keys]))], names=["doc", "k1", "k2", "h"])

    return docs.select("doc", "k1", "k2", "text").mapInArrow(run, "doc long, k1 long, k2 long, h long")


def shared_pieces(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, doc, start, h, p1, p2, words): the pieces of ``numbered`` documents whose last run of words two ids have."""
    anchors = _anchors(docs, window, gram)
    census = anchors.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    wanted = anchors.select("h", "k1", "k2").join(stored(census, "census"), "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            rows: list[tuple[int, int, int, bytes, bytes]] = []
            for k, (words, own) in enumerate(zip(_words(batch.column(3)), batch.column(4))):
                starts, counts, keys = pieces_of(vocabulary.of(words), window, gram)
                for i in np.flatnonzero(np.isin(keys, own.values.to_numpy())).tolist():
                    piece = b" ".join(words[starts[i] : starts[i] + counts[i] + window - 1])
                    rows.append((k, int(starts[i]), int(keys[i]), xxhash.xxh3_128_digest(piece), piece))
            k, start, h, digest, piece = list(zip(*rows)) or [()] * 5
            at, halves = pa.array(k, pa.int64()), np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], pa.array(start, pa.int32()), pa.array(h, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(piece, pa.binary())], names=["k1", "k2", "doc", "start", "h", "p1", "p2", "words"])

    joined = docs.select("k1", "k2", "doc", "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "doc", "text", "wanted")
    return joined.mapInArrow(run, "k1 long, k2 long, doc long, start int, h long, p1 long, p2 long, words binary")


def _bin_nodes(window: int):
    """A bin's pieces to the least id of each of their suffixes' nodes, where an id of the piece is larger."""
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("least", pa.list_(pa.int64()))])

    def run(bin_: pa.Table) -> pa.Table:
        codes: dict[bytes, int] = {}
        number = lambda w: codes.setdefault(w, len(codes))
        texts = [np.fromiter(map(number, words), np.int32, len(words)) for chunk in bin_.column("words").chunks for words in _words(chunk)]
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts)
        del texts, codes
        counts = lengths - window + 1
        # no window crosses the end of its piece, so pieces need no marks between them
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(first, counts) + inside
        ids = np.repeat(bin_.column("lo").to_numpy(), counts)
        least = least_below(*sorted_suffixes(flat, starts, window), ids, window)
        ends = np.cumsum(counts)
        repeated = np.flatnonzero(np.minimum.reduceat(least, ends - counts) < bin_.column("hi").to_numpy())
        at = pa.array(repeated)
        values = [least[ends[k] - counts[k] : ends[k]] for k in repeated.tolist()]
        return pa.Table.from_arrays([bin_.column("p1").take(at), bin_.column("p2").take(at), pa.array(values, pa.list_(pa.int64()))], schema=schema)

    return run


def _long_prefixes(pieces: DataFrame, window: int) -> DataFrame:
    """The same result for pieces of hot groups: prefixes of a whole window are counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, words in enumerate(_words(batch.column(3))):
                count = len(words) - window + 1
                digests = b"".join(xxhash.xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(count))
                halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                same = [batch.column(c).take(pa.array(np.full(count, k))) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(count, dtype=np.int32)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["p1", "p2", "lo", "i", "w1", "w2"])

    windows = pieces.select("p1", "p2", "lo", "words").mapInArrow(run, "p1 long, p2 long, lo long, i int, w1 long, w2 long")
    nodes = windows.groupBy("w1", "w2").agg(F.min("lo").alias("least"))
    found = windows.join(nodes, ["w1", "w2"]).groupBy("p1", "p2").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("s"))  # at most LONGEST
    return found.select("p1", "p2", F.transform("s", lambda x: x["least"]).alias("least"))


def repeat_nodes(pieces: DataFrame, window: int = WINDOW, most: int = MOST, bin_words: int = BIN_WORDS) -> DataFrame:
    """(p1, p2, least): for each different piece the least id that each of its suffixes' windows begins under."""
    different = stored(pieces.groupBy("h", "p1", "p2", "words").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")), "pieces")
    per_group = different.groupBy("h").agg(F.count("*").alias("n"))
    hot = stored(per_group.where(F.col("n") > most).select("h"), "hot")
    words = different.agg(F.sum(F.length("words"))).first()[0] or 0
    bins = max(1, int(words // (5 * bin_words)))  # five bytes a word at least, mostly
    usual = different.join(hot, "h", "left_anti").select("p1", "p2", "words", "lo", "hi", F.pmod(F.xxhash64("h"), F.lit(bins)).alias("bin"))
    trees = usual.groupBy("bin").applyInArrow(_bin_nodes(window), "p1 long, p2 long, least array<long>")
    return trees.unionByName(_long_prefixes(different.join(hot, "h", "left_semi"), window))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, bin_words: int = BIN_WORDS) -> DataFrame:
    """(k1, k2, spans) for ``numbered`` documents with repeats: spans are [first, after the last, ...] places of suffixes whose windows begin under a smaller id too."""
    pieces = stored(shared_pieces(docs, window, gram), "cut")

    @F.pandas_udf("array<int>")
    def runs(start: pd.Series, least: pd.Series, doc: pd.Series) -> pd.Series:
        found = []
        for s, own, d in zip(start, least, doc):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], np.asarray(own) < d, [False]]).astype(np.int8)))
            found.append((edges + s).astype(np.int32))
        return pd.Series(found)

    nodes = repeat_nodes(pieces, window, most, bin_words)
    places = pieces.select("k1", "k2", "doc", "start", "p1", "p2").join(nodes, ["p1", "p2"]).select("k1", "k2", runs("start", "least", "doc").alias("spans"))
    return places.where(F.size("spans") > 0).groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, bin_words: int = BIN_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` to one row for each row: doc_id, n_words, n_removed, removed ([first word, after the last, ...]), kept (words joined by one blank).

    A word goes if it is covered by a window of ``window`` words of its document that also begins in a document with a smaller id, judged on the
    input. Null and wordless texts have no words, texts shorter than a window lose none; null ids come after all others and, like
    equal ids, take nothing from one another; rows alike in both columns each get the same result; other columns are passed over;
    an empty table gives no rows.
    """
    if not 0 < gram <= window:
        raise ValueError("a run of words must fit in a window")
    rows = numbered(docs)
    spans = repeated_spans(rows, window, gram, most, bin_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, places, kept = [], [], [], []
            for words, own in zip(_words(batch.column(1)), batch.column(2)):
                covered = np.zeros(len(words) + 1, np.int64)
                if own.is_valid:
                    ends = own.values.to_numpy().reshape(-1, 2)
                    np.add.at(covered, ends[:, 0], 1)
                    np.add.at(covered, ends[:, 1] + window - 1, -1)
                off = np.cumsum(covered)[:-1] > 0
                total.append(len(words))
                gone.append(int(off.sum()))
                places.append(np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))).astype(np.int32))
                kept.append(b" ".join(w for w, x in zip(words, off) if not x) if gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, removed array<int>, kept string")
