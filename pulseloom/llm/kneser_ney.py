"""Interpolated modified Kneser-Ney language model, counted in Spark.

Words are hashed to 64 bits and numbered first: a shard of word hashes counts its words and gives the
frequent ones small numbers, so that what is sent later needs neither hashes nor a list of them in every block.

Counting, order by order from the highest: workers number words, merge the
n-grams of many texts before sending them, and send them as compressed blocks to
shards of the context's hash. Blocks hold distinct n-grams, so a hot context weighs
no more than its distinct successors. A shard merges its blocks and writes its
n-grams as a sorted hash array beside an array of counts, and its contexts likewise
(not those with one n-gram seen once: a context is there if it is an n-gram of the next lower order);
it sends on, merged again, each suffix with its number of distinct left extensions,
which is what the next lower order counts. What it sends on is stored, and the files of the shuffle
before are given back, so only one order's n-grams are in flight at a time. There are as many shards as
the texts' bytes ask for, so a shard stays as small however many texts there are.

Trigrams go by their middle word, so that a shard has all left extensions of its bigrams and all
bigrams of its contexts, and finishes both orders at once. The trigrams of a hot middle word (more than
an eighth of a shard's share of all words, known from the numbering) go by their whole context, and its bigrams are merged in a step of their own.

An n-gram is known by the 64-bit hash of its words' numbers: two of the n different n-grams of a shard
fall together with a chance of n**2 / 2**65, which is 4e-7 for four million. A sorted hash array keeps the next 48 bits
after those that name a bucket of some 32 entries, which from 2**20 entries on are all: words keep all 64 always.

Scoring: workers map the shards' files into memory, those of a kind one behind the other, look up the distinct n-grams of a
block of texts, of those whose context is there, by binary search over all shards at once, and combine the orders:
p(w|h) = max(c(hw) - D(c), 0) / c(h.) + g(h) p(w|h'), down to the uniform 1 / (V + 1).

A text is its words (A-Z lowered) and one end; its history is filled with a start
mark. n-grams of the highest order have raw counts, those of lower orders numbers of
distinct left extensions. Discounts follow from counts of counts.

A map holds no open file, so shards may be more than a process may open. On a store that isn't a local or mounted path
a worker copies the files of a kind to one of its own that it unlinks at once.
"""

from __future__ import annotations

import ctypes
import mmap
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from pulseloom.llm.store import fresh_path, local_or_fs, stored

BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b" begin"))
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
BLOCK_TOKENS = 3_000_000
#: Numbers of what isn't a word of the training texts: the start mark, and any other.
START, UNKNOWN = np.uint64(0), np.uint64(2**64 - 1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes_of(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts in a row, each with order-1 start marks before and one end after; and the numbers of tokens."""
    digest = xxhash.xxh3_64_intdigest
    split = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    out = np.full(int(sizes.sum()) + (order - 1) * len(split), BEGIN, np.uint64)
    ends = np.cumsum(sizes + order - 1)
    is_word = np.ones(len(out), bool)
    for back in range(1, order):
        is_word[ends - sizes - back] = False
    is_word[ends - 1] = False
    out[is_word] = np.fromiter(map(digest, chain.from_iterable(split)), np.uint64, int(sizes.sum()) - len(split))
    out[ends - 1] = END
    return out, sizes


def combine(columns: list[np.ndarray], rows: int) -> np.ndarray:
    """One hash for each row of word numbers."""
    h = np.full(rows, (0x9E3779B97F4A7C15 + len(columns)) % 2**64, np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def grams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Values, oldest first, of every token's n-gram; tokens are filled for that order."""
    total = int(sizes.sum())
    last = np.arange(total) + np.repeat((order - 1) * np.arange(1, len(sizes) + 1), sizes)
    return [tokens[last - back] for back in range(order - 1, -1, -1)]


def merge(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct rows by their combined hash, in its order, with the sums of their values."""
    key = combine(columns, len(columns[0]))
    order = ascending(key)
    key = key[order]
    first = _starts(key)
    return key[first], [c[order[first]] for c in columns], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def ascending(key: np.ndarray) -> np.ndarray:
    """Places of the keys in ascending order. Keys carry their places in their last bits, as plain sorting is several times as fast; the few that those bits decide are put right."""
    bits = np.uint64(len(key).bit_length())
    order = _by_first_bits(key, bits)
    ordered = key[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else order[np.argsort(ordered, kind="stable")]


def _by_first_bits(key: np.ndarray, bits: np.uint64) -> np.ndarray:
    mixed = (key >> bits << bits) | np.arange(len(key), dtype=np.uint64)
    mixed.sort()
    return (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, and each hash's place among them: from the first with the same leading bits on."""
    every = np.sort(hashes)
    every = every[_starts(every)]
    bits = np.uint64(max(1, len(every).bit_length()))
    lead = np.uint64(64) - bits
    at = np.searchsorted(every, np.arange(1 << int(bits), dtype=np.uint64) << lead)[(hashes >> lead).astype(np.int64)]
    behind = np.flatnonzero(every[at] < hashes) if len(hashes) else at
    while len(behind):
        at[behind] += 1
        behind = behind[every[at[behind]] < hashes[behind]]
    return every, at


def distinct_rows(columns: list[np.ndarray], values: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of integers below ``values`` in ascending order, and how often each occurs."""
    bits = max(1, (values - 1).bit_length())
    if bits * len(columns) <= 64:
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key = (key << np.uint64(bits)) | c.astype(np.uint64)
        key.sort()
        first = _starts(key)
        mask, kept = np.uint64((1 << bits) - 1), key[first]
        return [((kept >> np.uint64(bits * k)) & mask).astype(np.int64) for k in reversed(range(len(columns)))], np.diff(first, append=len(key))
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[first] for c in columns], np.diff(first, append=len(order))


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Integers by bytes of equal weight, and how many such bytes they need."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :width].T).tobytes()


def pack(columns: list[np.ndarray], values: list[np.ndarray], ordered: bool = False) -> bytes:
    """Rows of word numbers and counts, ascending, as a compressed block: the first column's differences, the other columns and the counts, by bytes of equal weight."""
    if not ordered:
        rows = np.lexsort(columns[::-1])
        columns, values = [c[rows] for c in columns], [v[rows] for v in values]
    parts = [_planes(x) for x in (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:], *values)]
    head = [len(columns[0]), len(columns), len(values), *(width for width, _ in parts)]
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<i8").tobytes() + b"".join(x for _, x in parts))


def unpack(block: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    rows, n_columns, n_values = np.frombuffer(raw, "<i8", 3).tolist()
    widths = np.frombuffer(raw, "<i8", n_columns + n_values, 24).tolist()
    at, out = 24 + 8 * len(widths), []
    for width in widths:
        values = np.zeros((rows, 8), np.uint8)
        values[:, :width] = np.frombuffer(raw, np.uint8, rows * width, at).reshape(width, rows).T
        out.append(values.view("<u8").reshape(-1))
        at += rows * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out[:n_columns], [v.astype(np.int64) for v in out[n_columns:]]


def is_hot(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which words are among the sorted hot ones."""
    return hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words if len(hot) else np.zeros(len(words), bool)


def _shards(columns: list[np.ndarray], bits: int, hot: np.ndarray) -> np.ndarray:
    """Shard of each n-gram: by its context's hash (trigrams by their middle word's, unless it's hot), or by its word where there is no context."""
    rows = len(columns[0])
    if len(columns) == 3:
        key = combine([columns[1]], rows)
        apart = np.flatnonzero(is_hot(columns[1], hot))
        key[apart] = combine([c[apart] for c in columns[:-1]], len(apart))
    else:
        key = combine(columns[:-1] or columns, rows)
    return (key >> np.uint64(64 - bits)).astype(np.int64)


SENT = "shard int, size int, block binary"
_SENT = pa.schema([("shard", pa.int32()), ("size", pa.int32()), ("block", pa.binary())])


def _blocks(columns: list[np.ndarray], values: list[np.ndarray], bits: int, hot: np.ndarray, ordered: bool = False) -> pa.RecordBatch:
    return _dealt(_shards(columns, bits, hot), columns, values, bits, ordered)


def _dealt(shard: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], bits: int, ordered: bool) -> pa.RecordBatch:
    order = np.argsort(shard.astype(np.uint16 if bits <= 16 else np.int64), kind="stable")
    edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    parts = [(s, order[edges[s] : edges[s + 1]]) for s in range(1 << bits) if edges[s] < edges[s + 1]]
    packed = [pack([c[at] for c in columns], [v[at] for v in values], ordered) for _, at in parts]
    return pa.RecordBatch.from_pydict({"shard": [s for s, _ in parts], "size": [len(columns)] * len(parts), "block": packed}, _SENT)


def _token_blocks(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and sizes as of ``hashes_of``, some three million tokens at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        values = batch.column(0)
        for at in range(0, len(values), 200):
            held.append(hashes_of(values[at : at + 200].to_pylist(), order))
            size += int(held[-1][1].sum())
            if size >= BLOCK_TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


WORDS = "word long, n long, id long, total long"


def number_words(texts: DataFrame, bits: int, share: float, folder: str) -> DataFrame:
    """Number the words of the only column, from 1 on: by falling counts within shards of their hashes, shard by shard in turn.

    Hashes and numbers are written beside the model; returned are each shard's tokens, and
    those words that make up at least that share of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _token_blocks(batches, 1):
            word, n = np.unique(tokens, return_counts=True)
            yield _dealt(_word_shards(word, bits), [word], [n], bits, True)

    def number(key: tuple, batch: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        parts = [unpack(b.as_py()) for b in batch.column("block")]
        every, at = np.unique(np.concatenate([w for (w,), _ in parts]), return_inverse=True)
        n = np.zeros(len(every), np.int64)
        np.add.at(n, at, np.concatenate([c for _, (c,) in parts]))
        rank = np.empty(len(every), "<u4")
        rank[np.argsort(-n, kind="stable")] = np.arange(len(every))
        _write(folder, "v", shard, {"whole": every.astype("<u8"), "rank": rank})
        total = int(n.sum())
        often = np.flatnonzero(n >= share * total)
        return pa.table({"word": np.append(every[often], np.uint64(0)).view(np.int64), "n": np.append(n[often], 0), "id": np.append(_numbers(rank[often], shard, bits), np.uint64(0)).view(np.int64), "total": np.append(np.zeros(len(often), np.int64), total)})

    return stored(texts.mapInArrow(run, SENT).groupBy("shard").applyInArrow(number, WORDS), "words")


def _word_shards(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def _numbers(rank: np.ndarray, shard: int | np.ndarray, bits: int) -> np.ndarray:
    return ((rank.astype(np.uint64) << np.uint64(bits)) | np.asarray(shard, np.uint64)) + np.uint64(1)


def hot_words(texts: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of the words that make up at least that share of all, of texts or of what ``number_words`` found: at most 1 / share of them."""
    found = texts if "total" in texts.columns else number_words(texts, 3, share, fresh_path(texts.sparkSession, "numbers"))
    total = found.agg(F.sum("total")).first()[0] or 0
    rows = found.where((F.col("n") > 0) & (F.col("n") >= share * total)).select("word").collect()  # 1 / share words at most
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def count_texts(texts: DataFrame, model: Model) -> DataFrame:
    """Blocks of the highest order's n-grams, with counts, of the only column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for tokens, sizes in _token_blocks(batches, model.order):
            word, place = ranked(tokens)
            number = arrays.numbers(word)
            order = np.argsort(number)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            columns, counts = distinct_rows(grams(rank[place], sizes, model.order), len(order))
            yield _blocks([number[order[c]] for c in columns], [counts], model.bits, model.hot, True)

    return texts.mapInArrow(run, SENT)


#: Of a context: how many of its n-grams have the counts 1, 2, and more. The sum of counts follows where none has more; else it's kept apart.
CONTEXT = 3
NUMBERS = 7  # of one order and shard: n-grams with counts 1, 2, 3, 4; sum of counts; n-grams; sum of raw counts


def _counts(name: str) -> dict[str, str]:
    return {name: "<u1", f"{name}at": "<u8", f"{name}big": "<u8"}


#: Arrays of a shard's files: of words' numbers, single words, longer n-grams and contexts.
_GRAMS = {"low": "<u4", "more": "<u2", "start": "<u4"}
KINDS = {"v": {"whole": "<u8", "rank": "<u4"}, "n1": {"whole": "<u8"} | _counts("count") | _counts("raw"), "n": _GRAMS | _counts("count"), "c": _GRAMS | _counts("table") | {"richat": "<u4", "rich": "<u8"}}


def _kinds(stem: str) -> dict[str, str]:
    return KINDS.get(stem) or KINDS[stem.lstrip("h")[0]]


def _write(folder: str, stem: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as one file of the shard: where each begins and how long it is, then the arrays; a repeated task writes the same again."""
    system, path = local_or_fs(folder)
    system.create_dir(path, recursive=True)
    every = [np.ascontiguousarray(arrays[kind], dtype) for kind, dtype in _kinds(stem).items()]
    rooms = np.array([16 * len(every), *(v.nbytes + -v.nbytes % 8 for v in every)])
    head = np.stack([np.cumsum(rooms)[:-1], [len(v) for v in every]], 1).astype("<u8")
    name = f"{stem}-{shard:05d}"
    temporary = f"{path}/_{name}-{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(temporary) as sink:
        for values in (head, *every):
            sink.write(values.reshape(-1).view(np.uint8).data)
            sink.write(bytes(-values.nbytes % 8))
    system.move(temporary, f"{path}/{name}")


def _counts_as_files(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those from 255 on by position. Rows of several counts lie one after the other."""
    counts = counts.reshape(-1)
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}at": large.astype("<u8"), f"{name}big": counts[large].astype("<u8")}


def _grams_as_files(gram: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes by buckets of their first bits: where each begins, and the next 32 and 16 bits of each hash."""
    bits = np.uint64(bucket_bits(len(gram)))
    start = np.searchsorted(_bucket(gram, bits), np.arange((1 << int(bits)) + 1))
    return {"low": _low(gram, bits), "more": _more(gram, bits), "start": start.astype("<u4")}


def bucket_bits(n: int) -> int:
    return max(0, n.bit_length() - 5)


def _bucket(gram: np.ndarray, bits: np.uint64 | np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(1) >> (np.uint64(63) - bits)).astype(np.int64)


def _low(gram: np.ndarray, bits: np.uint64 | np.ndarray) -> np.ndarray:
    return ((gram << bits) >> np.uint64(32)).astype("<u4")


def _more(gram: np.ndarray, bits: np.uint64 | np.ndarray) -> np.ndarray:
    return ((gram << (bits + np.uint64(32))) >> np.uint64(48)).astype("<u2")


def _search(values: np.ndarray, want: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Between two places each, where values ascend: the first place whose value isn't less than the wanted one."""
    at, left, last = at.copy(), end - at, len(values) - 1
    while left.any():
        half = left >> 1
        less = values[np.minimum(at + half, last)] < want
        less &= left > 0
        half += less
        at += np.where(less, half, 0)
        left = np.where(less, left - half, half)
    return at


def _find(low: np.ndarray, start: np.ndarray, key: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are held, their places) in one shard's arrays."""
    zero = np.zeros(len(key), np.int64)
    return _find_all(key, np.full(len(key), (len(start) - 1).bit_length() - 1, np.uint64), low, zero, start, zero, more, zero)


def _find_all(key: np.ndarray, bits: np.ndarray, low: np.ndarray, low_at: np.ndarray, start: np.ndarray, start_at: np.ndarray, more: np.ndarray | None, more_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are held, their places in their shards), by binary search within each key's bucket; then by the 16 bits of ``more``.

    ``bits`` are those of each key's shard, and the arrays of its shard begin at ``low_at``, ``start_at`` and ``more_at``.
    """
    want, bucket = _low(key, bits), start_at + _bucket(key, bits)
    begin, end = low_at + start[bucket], low_at + start[bucket + 1]
    at, last = _search(low, want, begin, end), len(low) - 1
    held = (at < end) & (low[np.minimum(at, last)] == want)
    rows, at = np.flatnonzero(held), at[held]
    if more is not None:
        next_bits, to_more = _more(key[rows], bits[rows]), (more_at - low_at)[rows]
        other = np.flatnonzero(more[at + to_more] != next_bits)
        while len(other):  # hashes with the same 32 bits lie side by side
            other = other[(at[other] + 1 < end[rows[other]]) & (low[np.minimum(at[other] + 1, last)] == want[rows[other]])]
            at[other] += 1
            other = other[more[at[other] + to_more[other]] != next_bits[other]]
        same = more[at + to_more] == next_bits
        rows, at = rows[same], at[same]
    return rows, at - low_at[rows]


def merge_shards(blocks: DataFrame, order: int, folder: str, bits: int, hot: np.ndarray) -> DataFrame:
    """Write the n-grams and contexts of one order, shard by shard; send on blocks for the next lower order.

    Values of blocks: counts for the highest order; numbers of left extensions and sums of raw
    counts below. Blocks of other sizes (size 0: the numbers of the orders done so far) pass through.
    """

    def finish(shard: int, stem: str, size: int, gram: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        """Write one shard's n-grams and contexts; their numbers as a block."""
        count, raw = values[0], values[-1]
        seen = [(count == k).astype(np.int64) for k in (1, 2, 3, 4)]
        # words are few: their hashes are kept whole, so that known words and base scores don't rest on 32 bits
        files = ({"whole": gram.astype("<u8")} if size == 1 else _grams_as_files(gram)) | _counts_as_files("count", count)
        if size == 1:
            files |= _counts_as_files("raw", raw)
        else:
            context = combine(columns[:-1], len(gram))
            at = ascending(context)
            first = _starts(context[at])
            table = np.stack([np.add.reduceat(v[at], first) for v in (seen[0], seen[1], (count > 2).astype(np.int64))], 1)
            # one n-gram seen once is what a context has unless it's listed; of start marks there is no n-gram of the next lower order
            listed = (table != (1, 0, 0)).any(axis=1) | (columns[-2][at[first]] == START)
            sums = np.add.reduceat(count[at], first)[listed]
            first, table = first[listed], table[listed]
            rich = np.flatnonzero(table[:, 2])
            sums = {"richat": rich.astype("<u4"), "rich": sums[rich].astype("<u8")}
            _write(folder, f"{stem}c{size}", shard, _grams_as_files(context[at][first]) | _counts_as_files("table", table) | sums)
        _write(folder, f"{stem}n{size}", shard, files)
        numbers = [int(x.sum()) for x in seen] + [int(count.sum()), len(count), int(raw.sum())]
        return pa.RecordBatch.from_pydict({"shard": [shard], "size": [0], "block": [np.array([size, *numbers], "<i8").tobytes()]}, _SENT)

    def suffixes(columns: list[np.ndarray], raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        return merge(columns[1:], [np.ones(len(raw), np.int64), raw])

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        mine = pa.compute.equal(batch.column("size"), order)
        passed = batch.filter(pa.compute.invert(mine)).select(["shard", "size", "block"]).cast(_SENT)
        parts = [unpack(b.as_py()) for b in batch.filter(mine).column("block")]
        if not parts:
            return passed
        columns = [np.concatenate(x) for x in zip(*(p[0] for p in parts))]
        values = [np.concatenate(x) for x in zip(*(p[1] for p in parts))]
        del parts
        gram, columns, values = merge(columns, values)
        # bigrams that come as blocks beside a trigram model are a hot word's
        out = [finish(shard, "h" if order == 2 and len(hot) else "", order, gram, columns, values)]
        if order > 1:
            gram, columns, values = suffixes(columns, values[-1])
            if order == 3:
                apart = is_hot(columns[0], hot)
                if apart.any():
                    out.append(_blocks([c[apart] for c in columns], [v[apart] for v in values], bits, hot))
                gram, columns, values = gram[~apart], [c[~apart] for c in columns], [v[~apart] for v in values]
                if len(gram):
                    out.append(finish(shard, "", 2, gram, columns, values))
                    _, columns, values = suffixes(columns, values[-1])
            if len(columns[0]):
                out.append(_blocks(columns, values, bits, hot))
        return pa.concat_tables([passed, pa.Table.from_batches(out)])

    return blocks.groupBy("shard").applyInArrow(run, SENT)


@dataclass
class Model:
    """Where the arrays are, each order's seven numbers, and the hot words' numbers."""

    folder: str
    order: int
    bits: int
    numbers: dict[int, list[int]]
    hot: np.ndarray

    @property
    def words(self) -> int:
        return self.numbers[1][5]

    @property
    def tokens(self) -> int:
        return self.numbers[1][6]

    def discounts(self, order: int) -> np.ndarray:
        """D by count: none for 0, then for one, two and more."""
        return np.concatenate(([0.0], discounts(np.array(self.numbers[order][:4], float))))


def discounts(n: np.ndarray) -> np.ndarray:
    """D for counts of one, two and more; one half where counts of counts don't tell, and never outside 0.01 to the count less 0.01."""
    n1, n2, n3, n4 = n
    if n1 <= 0 or n2 <= 0:
        return np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 > 0 else 0.5]
    return np.array([min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1)])


#: Bytes of text to a shard: some four million tokens.
SHARD_BYTES = 24_000_000
GIVE_BACK = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def train(texts: DataFrame, order: int = 2, bits: int | None = None, folder: str | None = None) -> Model:
    """A model from a single text column. Null texts are empty; repeated rows count each; an empty table gives a model without n-grams."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = texts.sparkSession
    folder = folder or fresh_path(spark, "kneser-ney")
    if bits is None:
        size = texts.agg(F.sum(F.octet_length(F.col(texts.columns[0])))).first()[0] or 0
        bits = max(3, (size // SHARD_BYTES).bit_length())
    share = 1 / (8 << bits)
    before = spark.conf.get(GIVE_BACK, "false")
    spark.conf.set(GIVE_BACK, "true")
    try:
        words = number_words(texts, bits, share, folder)
        often = [int(w) for w in hot_words(words, share).view(np.int64)] if order > 2 else []
        hot = np.sort(np.array([r["id"] for r in words.where(F.col("word").isin(often) & (F.col("n") > 0)).collect()] if often else [], np.int64).view(np.uint64))
        model = Model(folder, order, bits, {}, hot)
        blocks = count_texts(texts, model)
        for k in [k for k in range(order, 0, -1) if k != 2 or order == 2 or len(hot)]:  # without hot words bigrams are done with the trigrams
            blocks = stored(merge_shards(blocks, k, folder, bits, hot), f"order-{k}")
    finally:
        spark.conf.set(GIVE_BACK, before)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 1 + NUMBERS)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], names=names)

    names = ["k", *(f"n{i}" for i in range(NUMBERS))]
    sums = blocks.select("block").mapInArrow(decoded, ", ".join(f"{x} long" for x in names)).groupBy("k").agg(*[F.sum(x).alias(x) for x in names[1:]])
    model.numbers |= {k: [0] * NUMBERS for k in range(1, order + 1)} | {r["k"]: list(r)[1:] for r in sums.collect()}  # one row an order
    return model


#: Files that a worker maps; more are copied to one. Linux allows a process some 65,530 maps.
MOST_MAPS = 30_000
_MMAP = ctypes.CDLL(None, use_errno=True).mmap
_MMAP.restype, _MMAP.argtypes = ctypes.c_void_p, (ctypes.c_void_p, ctypes.c_size_t, ctypes.c_int, ctypes.c_int, ctypes.c_int, ctypes.c_long)
_FIXED = 0x10


def _mapped(paths: list[str], sizes: list[int], at: list[int], room: int) -> mmap.mmap:
    """Files at the given places of one stretch of addresses. No file stays open."""
    stretch = mmap.mmap(-1, room, mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS | mmap.MAP_NORESERVE, mmap.PROT_READ)
    begin = np.frombuffer(stretch, np.uint8).ctypes.data
    for path, size, place in zip(paths, sizes, at):
        file = os.open(path, os.O_RDONLY)
        try:
            if _MMAP(begin + place, size, mmap.PROT_READ, mmap.MAP_PRIVATE | _FIXED, file, 0) != begin + place:
                raise OSError(ctypes.get_errno(), "mmap", path)
        finally:
            os.close(file)
    return stretch


class Files:
    """The arrays of one kind of file of all shards, one behind the other: a look-up takes the shards of its keys together."""

    def __init__(self, model: Model, stem: str):
        system, folder = local_or_fs(model.folder)
        kinds = {kind: np.dtype(dtype) for kind, dtype in _kinds(stem).items()}
        names = [f"{folder}/{stem}-{s:05d}" for s in range(1 << model.bits)]
        sizes = np.array([f.size or 0 for f in system.get_file_info(names)], np.int64)
        self.there = sizes > 0
        shards, sizes = np.flatnonzero(self.there), sizes[self.there]
        rooms = -(-sizes // mmap.ALLOCATIONGRANULARITY) * mmap.ALLOCATIONGRANULARITY
        begin, room, names = np.cumsum(rooms) - rooms, int(rooms.sum()), [names[s] for s in shards]
        self.maps = len(shards)
        self.first, self.sizes = ({kind: np.zeros(len(self.there), np.int64) for kind in kinds} for _ in range(2))
        if not room:
            return
        if system.type_name == "local" and self.maps <= MOST_MAPS:
            whole = _mapped(names, sizes.tolist(), begin.tolist(), room)
        else:
            self.maps = 1
            whole = self._copied(system, names, begin.tolist(), room)
        self.views = {kind: np.frombuffer(whole, dtype) for kind, dtype in kinds.items()}
        head = np.frombuffer(whole, "<u8")[begin[:, None] // 8 + np.arange(2 * len(kinds))].astype(np.int64)
        for k, (kind, dtype) in enumerate(kinds.items()):
            self.first[kind][shards] = (begin + head[:, 2 * k]) // dtype.itemsize
            self.sizes[kind][shards] = head[:, 2 * k + 1]
        if "start" in kinds:
            self.bits = (np.frexp(np.maximum(self.sizes["start"] - 1, 1))[1] - 1).astype(np.uint64)

    @staticmethod
    def _copied(system, names: list[str], begin: list[int], room: int) -> mmap.mmap:
        with tempfile.TemporaryFile() as own:
            for name, at in zip(names, begin):
                own.seek(at)
                with system.open_input_stream(name) as source:
                    while chunk := source.read(1 << 24):
                        own.write(chunk)
            own.truncate(room)
            own.flush()
            return mmap.mmap(own.fileno(), room, access=mmap.ACCESS_READ)

    def places(self, key: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys their shards hold, their places there)."""
        rows = np.flatnonzero(self.there[shard])
        if not len(rows):
            return rows, rows
        key, shard = key[rows], shard[rows]
        if "whole" in self.views:
            whole, at = self.views["whole"], self.first["whole"][shard]
            end = at + self.sizes["whole"][shard]
            found = _search(whole, key, at, end)
            hit = np.flatnonzero((found < end) & (whole[np.minimum(found, len(whole) - 1)] == key))
            return rows[hit], (found - at)[hit]
        hit, where = _find_all(key, self.bits[shard], *(x for kind in ("low", "start", "more") for x in (self.views[kind], self.first[kind][shard])))
        return rows[hit], where

    def read(self, kind: str, shard: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self.views[kind][self.first[kind][shard] + places]

    def counts(self, kind: str, shard: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Counts at the given places of arrays that ``_counts_as_files`` made."""
        got = self.read(kind, shard, places).astype(np.int64)
        big = np.flatnonzero(got == 255)
        if len(big):
            got[big] = self.apart(f"{kind}at", f"{kind}big", shard[big], places[big])
        return got

    def apart(self, at: str, values: str, shard: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of an array that lists values only of some places, those of the given places, which are all listed."""
        first = self.first[at][shard]
        return self.read(values, shard, _search(self.views[at], places.astype(self.views[at].dtype), first, first + self.sizes[at][shard]) - first)


#: Distinct keys that are looked up at a time, so that they stay in a core's cache.
KEYS = 1 << 15


class Arrays:
    """A worker's view of a model's files, mapped when first used; if they are too many to stay so, those of one kind at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.found: dict[str, Files] = {}

    def files(self, stem: str) -> Files:
        if stem not in self.found:
            new = Files(self.model, stem)
            if new.maps + sum(f.maps for f in self.found.values()) > MOST_MAPS:
                self.found.clear()
            self.found[stem] = new
        return self.found[stem]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of sorted distinct word hashes."""
        out = np.full(len(words), UNKNOWN, np.uint64)
        files, shard = self.files("v"), _word_shards(words, self.model.bits)
        for at in range(0, len(words), KEYS):
            hit, where = files.places(words[at : at + KEYS], shard[at : at + KEYS])
            if len(hit):
                own = shard[at + hit]
                out[at + hit] = _numbers(files.read("rank", own, where), own.astype(np.uint64), self.model.bits)
        out[words == BEGIN] = START
        return out

    def looked_up(self, stem: str, key: np.ndarray, shard: np.ndarray, kinds: int, values: Callable[[Files, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """So many values of each key, from the shards and places of those that are held; others' are 0. Equal keys are looked up once."""
        bits, files = self.model.bits, self.files(stem)
        order = _by_first_bits((shard.astype(np.uint64) << np.uint64(64 - bits)) | (key >> np.uint64(bits)), np.uint64(len(key).bit_length()))
        first = _starts(key[order])
        asked = order[first]
        key, shard = key[asked], shard[asked]
        found = [np.zeros(len(key)) for _ in range(kinds)]
        for at in range(0, len(key), KEYS):
            hit, where = files.places(key[at : at + KEYS], shard[at : at + KEYS])
            if len(hit):
                for to, got in zip(found, values(files, shard[at + hit], where)):
                    to[at + hit] = got
        times, out = np.diff(first, append=len(order)), [np.empty(len(order)) for _ in range(kinds)]
        for to, got in zip(out, found):
            to[order] = np.repeat(got, times)
        return out

    def counts(self, stem: str, kinds: tuple[str, ...], key: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        return [x.astype(np.int64) for x in self.looked_up(stem, key, shard, len(kinds), lambda files, own, where: [files.counts(kind, own, where) for kind in kinds])]

    def contexts(self, stem: str, key: np.ndarray, shard: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Each context's sum of counts (none: 0), and what the discounts take from it."""

        def values(files: Files, own: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
            one, two, more = (files.counts("table", own, CONTEXT * where + k) for k in range(CONTEXT))
            total = one + 2 * two
            rich = np.flatnonzero(more)
            if len(rich):
                total[rich] = files.apart("richat", "rich", own[rich], where[rich])
            return [total, one * d[1] + two * d[2] + more * d[3]]

        return self.looked_up(stem, key, shard, 2, values)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: tokens, known tokens, base score and the model's log10 probability."""
        model = self.model
        tokens, sizes = hashes_of(texts, model.order)
        words, place = ranked(tokens)
        number = self.numbers(words)
        spots = grams(place, sizes, model.order)
        columns = [number[c] for c in spots]
        key = combine([number], len(number))
        count, raw = self.counts("n1", ("count", "raw"), key, _shards([number], model.bits, model.hot))
        p = np.full(len(number), 1.0 / (model.words + 1))
        n1, n2, _, _, total, every, _ = model.numbers[1]
        if total:
            d = model.discounts(1)
            rest = (d[1] * n1 + d[2] * n2 + d[3] * (every - n1 - n2)) / total
            p = np.maximum(count - d[np.minimum(count, 3)], 0) / total + rest * p
        base = np.log10((raw + 1) / (model.tokens + model.words + 1))[spots[-1]]
        known = (raw > 0)[spots[-1]]
        p = p[spots[-1]]
        first = np.cumsum(sizes) - sizes
        there = known  # whether a token's n-gram of the order before is
        for k in range(2, model.order + 1):
            inner = np.append(False, there[:-1])  # contexts of words; those of start marks alone are listed if there are any
            inner[first] = False
            asked = inner.copy()
            asked[first] = True
            at = np.flatnonzero(asked)
            own = [c[at] for c in columns[-k:]]
            key, context, shard = combine(own, len(at)), combine(own[:-1], len(at)), _shards(own, model.bits, model.hot)
            d = model.discounts(k)
            (count,), (total, taken) = self.counts(f"n{k}", ("count",), key, shard), self.contexts(f"c{k}", context, shard, d)
            apart = np.flatnonzero(is_hot(own[0], model.hot)) if k == 2 else []
            if len(apart):
                (count[apart],), (total[apart], taken[apart]) = self.counts("hn2", ("count",), key[apart], shard[apart]), self.contexts("hc2", context[apart], shard[apart], d)
            single = inner[at] & (total == 0)
            total[single], taken[single] = 1, d[1]
            rest = np.where(total > 0, taken / np.maximum(total, 1), 1.0)
            p[at] = np.maximum(count - d[np.minimum(count, 3)], 0) / np.maximum(total, 1) + rest * p[at]
            there = np.zeros(len(p), bool)
            there[at] = count > 0
        return sizes, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


#: Bytes of text that are scored at a time, and one text at most beyond.
SCORED_BYTES = 4_000_000


def cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """From where to where rows are taken together: their sizes sum up to less than ``most``, but for the first of them."""
    sums = np.cumsum(sizes, dtype=np.int64)
    edges = np.unique(np.append(np.flatnonzero(np.diff(sums // most, prepend=0)), [0, len(sizes)])).tolist()
    return list(zip(edges, edges[1:]))


def score_texts(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """``docs(text, *carried)`` to carried, n_tokens, n_known, train_tokens, base_score and score (log10; perplexity is 10 ** (-score / n_tokens))."""
    rows = docs.select(F.col("text").cast("string").alias("text"), *carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in batches:
            for at, end in cuts(pa.compute.binary_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False), SCORED_BYTES):
                part = batch.slice(at, end - at)
                n, known, base, score = arrays.score(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score)], names=[*part.schema.names[1:], "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out and the columns of ``score_texts`` for every row of ``docs``.

    Rows that are held out aren't learned from. A null id is not held out; a null text is
    empty (one end token); repeated rows are learned and scored each; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    model = train(rows.where(~F.col("held_out")).select("text"), order)
    return score_texts(rows, model, "doc_id", "held_out")
