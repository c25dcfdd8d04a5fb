"""Hierarchical multi-length packing of documents into token sequences.

The context sizes (tiers) are powers of two, the largest being the window. Each task
takes its documents in bounded blocks and packs a block in four steps:

1. Route: a document gives full windows for as long as it fills them; what is left
   (shorter than a window) goes to the smallest tier that holds it.
2. Pack: every tier, longest first, opens sequences of its size, longest pieces first.
3. Fill: the gap of a sequence takes whole pieces of shorter tiers, the longest that fit.
   What then is missing is sliced off one piece, which serves gap after gap until it is
   used up, so few documents are cut. With no shorter piece left, one of the same tier is sliced.
4. Balance: sequences of one tier are dealt to step groups whose counts differ by one at most, so that
   the sums of attention cost (squared piece lengths) are close.

What cannot fill a sequence at the end of a block is split into smaller tiers. Only
a rest shorter than the smallest tier is ever padded. Packing needs no shuffle:
memory is bounded by a block and a lost task is packed again in the same way.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm import bpe

TIERS = (128, 256, 512, 1024)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens int, step_group long"

#: A piece of a document in a block: (document's index in the block, start, length).
Piece = tuple[int, int, int]


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Documents of the given token counts as (tier, pieces) sequences.

    Every token lies in exactly one piece. All sequences are full but for at most one,
    which holds fewer tokens than the smallest tier. Ties go to the earlier document.
    """
    window = tiers[-1]
    done: list[tuple[int, list[Piece]]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, -doc, start), sorted

    def route(length: int, doc: int, start: int) -> None:
        insort(waiting[tiers[bisect_left(tiers, length)]], (length, doc, start))

    for doc, n in enumerate(lengths):
        full = n // window * window
        done += [(window, [(doc, at, window)]) for at in range(0, full, window)]
        if n > full:
            waiting[tiers[bisect_left(tiers, n - full)]].append((n - full, -doc, full))
    for held in waiting.values():  # sorted once: a block may hold a million short texts
        held.sort()

    rest: list[Piece] = []
    for level in reversed(range(len(tiers))):
        tier, shorter = tiers[level], tiers[level - 1 :: -1] if level else ()
        own = waiting[tier]
        loose: tuple[int, int, int] | None = None  # the piece that is being sliced
        while own:
            length, doc, start = own.pop()
            pieces, gap = [(-doc, start, length)], tier - length
            for source in shorter or (tier,):
                held = waiting[source]
                while gap and (at := bisect_left(held, (gap + 1,))):
                    length, doc, start = held.pop(at - 1)
                    pieces.append((-doc, start, length))
                    gap -= length
            while gap:
                if loose is None:
                    source = next((t for t in shorter if waiting[t]), None)
                    if source is None and not own:
                        break
                    loose = waiting[source].pop() if source else own.pop(0)
                length, doc, start = loose
                taken = min(gap, length)
                pieces.append((-doc, start, taken))
                gap -= taken
                loose = (length - taken, doc, start + taken) if taken < length else None
            if gap:
                rest = pieces  # all that is left of this and the shorter tiers
            else:
                done.append((tier, pieces))
        if loose:
            route(*loose)
            # a slice of this tier may be as long as the tier still
            if waiting[tier]:
                length, doc, start = waiting[tier].pop()
                rest = [(-doc, start, length)]
        if rest:
            break
    if rest:
        left = sum(p[2] for p in rest) + sum(x[0] for held in waiting.values() for x in held)
        queue = deque([*rest, *((-doc, start, length) for t in reversed(tiers) for length, doc, start in reversed(waiting[t]))])
        for tier in reversed(tiers):
            while left >= tier:
                done.append((tier, _take(queue, tier)))
                left -= tier
        if left:
            done.append((window, list(queue)))
    return done


def _take(pieces: deque[Piece], tokens: int) -> list[Piece]:
    """That many tokens off the front of the pieces."""
    taken = []
    while tokens:
        doc, start, length = pieces.popleft()
        taken.append((doc, start, min(length, tokens)))
        if length > tokens:
            pieces.appendleft((doc, start + tokens, length - tokens))
        tokens -= taken[-1][2]
    return taken


def step_groups(costs: list[int], per_group: int) -> list[int]:
    """Group of each sequence: groups of at most ``per_group`` whose counts differ by one at most, dealt largest costs first, a round at a time, to the cheapest groups."""
    count = max(1, -(-len(costs) // per_group))
    total, group = [0] * count, [0] * len(costs)
    order = sorted(range(len(costs)), key=lambda k: (-costs[k], k))
    for at in range(0, len(order), count):
        cheapest = sorted(range(count), key=lambda g: (total[g], g))
        for k, g in zip(order[at : at + count], cheapest):
            group[k] = g
            total[g] += costs[k]
    return group


def pack_documents(docs: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY, tiers: tuple[int, ...] = TIERS, end_id: int = 0, block_tokens: int = 1 << 20, group_sequences: int = 64, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence (columns of ``SCHEMA``, and ids when asked for).

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Sequences are at most ``tiers[-1]`` tokens and full, except one shorter than
    ``tiers[0]`` for each block of about ``block_tokens``. Repeated rows are packed as
    documents of their own; other columns are ignored; an empty table gives no rows.
    sequence_id is unique over the table: the input partition's number and a counter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        count, held, groups = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held, groups
            packed = pack_block([len(x) for x in ids], tiers)
            packed.sort(key=lambda x: x[0])  # by tier, which a step group doesn't mix
            costs = [sum(p[2] ** 2 for p in pieces) for _, pieces in packed]
            chosen: list[int] = []
            for tier in tiers:
                own = [c for (t, _), c in zip(packed, costs) if t == tier]
                dealt = step_groups(own, group_sequences)
                chosen += [groups + g for g in dealt]
                groups += max(dealt, default=-1) + 1
            rows = []
            for (tier, pieces), group in zip(packed, chosen):
                offset, total = 0, sum(p[2] for p in pieces)
                for doc, start, length in pieces:
                    part = ids[doc][start : start + length]
                    rows.append((names[doc], start, length, zlib.crc32(part), len(ids[doc]), base + count, offset, tier, total, base + group, part.tobytes() if with_ids else None))
                    offset += length
                count += 1
            names.clear(), ids.clear()
            held = 0
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            keys = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array(columns[10], pa.binary()))
                keys.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=keys)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = bpe.encode(text.as_py() or "", vocabulary)
                whole = np.empty(len(got) + 1, "<u4")
                whole[:-1], whole[-1] = got, end_id
                names.append(name)
                ids.append(whole)
                held += len(whole)
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    schema = SCHEMA + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
