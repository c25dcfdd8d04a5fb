"""SentencePiece-style encoding: Unigram Viterbi over a double-array trie of pieces.

The trie runs over UTF-8 bytes; its two arrays are built once on the driver. Texts are
cut where no piece can reach across (before runs of the whitespace marker, and around
characters that no piece holds), so a segment's best path is part of its text's best
path. Workers find the best paths of a batch's new segments together: all trie walks
advance a byte at a time in numpy, then all paths a place at a time. A bounded cache
keeps the ids of segments.

Ties go to the piece that starts first, as in the usual implementation. A character
without a piece costs the least score less ten and becomes byte pieces, where the model
has them, or the unknown id.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Pieces:
    """A vocabulary: pieces, log scores, kinds, and whether texts get a marker in front."""

    text: list[str]
    score: np.ndarray
    kind: np.ndarray
    prefix: bool = True

    @classmethod
    def load(cls, path: str) -> "Pieces":
        """From a model file; only its pieces and the dummy-prefix flag are used."""
        text, score, kind, prefix = [], [], [], True
        with open(path, "rb") as source:
            for k, value in _fields(source.read()):
                if k == 1:
                    own = dict(_fields(value))
                    text.append(own[1].decode())
                    score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                    kind.append(own.get(3, NORMAL))
                elif k == 3:
                    prefix = bool(dict(_fields(value)).get(3, 1))
        return cls(text, np.array(score, np.float64), np.array(kind, np.int64), prefix)


class DoubleArray:
    """A trie in two arrays: from state s by byte b to t = base[s] + b + 1, if check[t] is s. value[t] is a piece or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, piece in keys.items():
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    values.append(-1)
                node = children[node][byte]
            values[node] = piece
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        low = 1
        todo = [(0, 0)]
        while todo:
            node, state = todo.pop()
            if not children[node]:
                continue
            steps = sorted(children[node])
            while used[low]:
                low += 1
            at = low - steps[0] - 1
            while at < 0 or any(used[at + b + 1] for b in steps):
                at = used.find(0, at + steps[0] + 2) - steps[0] - 1
                if at + 300 > len(used):
                    grown = len(used)
                    used += bytes(grown)
                    self.base, self.check, self.value = np.append(self.base, np.zeros(grown, np.int32)), np.append(self.check, np.full(grown, -1, np.int32)), np.append(self.value, np.full(grown, -1, np.int32))
            self.base[state] = at
            for b in steps:
                used[at + b + 1] = 1
                self.check[at + b + 1] = state
                self.value[at + b + 1] = values[children[node][b]]
                todo.append((children[node][b], at + b + 1))
        end = int(np.flatnonzero(self.check >= 0).max(initial=0)) + 300
        self.base, self.check, self.value = self.base[:end].copy(), self.check[:end].copy(), self.value[:end].copy()
        self.check = np.append(self.check, np.full(max(0, end - len(self.check)), -1, np.int32))


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        usable = [k for k, kind in enumerate(pieces.kind) if kind in (NORMAL, USER)]
        self.trie = DoubleArray({pieces.text[k].encode(): k for k in reversed(usable)})
        self.score = pieces.score
        self.unknown_score = (min(pieces.score[usable]) if usable else 0.0) - 10
        self.unknown = next((k for k, kind in enumerate(pieces.kind) if kind == UNKNOWN), 0)
        self.byte_ids = {int(pieces.text[k][3:5], 16): k for k, kind in enumerate(pieces.kind) if kind == BYTE}
        inner = "".join(pieces.text[k] for k in usable)
        apart = not any(MARK in pieces.text[k].lstrip(MARK) for k in usable)
        never = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        # without the first property a text is one segment
        self.cut = re.compile(f"{MARK}*[^{MARK}{never}]+|{MARK}+" + (f"|[{never}]" if never else "")) if apart else re.compile(r"(?s).+")
        self.cache: dict[str, bytes] = {}
        raw = [t.encode() for t in pieces.text]
        for byte, k in self.byte_ids.items():
            raw[k] = bytes([byte])
        for k, kind in enumerate(pieces.kind):
            if kind == CONTROL:
                raw[k] = b""
            elif kind == UNKNOWN:
                raw[k] = " ⁇ ".encode()
        self.raw = raw

    def normal(self, text: str) -> str:
        return ((MARK if self.pieces.prefix else "") + text.replace(" ", MARK)) if text else ""

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(self.normal(text))

    def learn(self, segments: set[str]) -> None:
        """Put the ids of segments into the cache."""
        new = [s for s in segments if s not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list(segments)
        new.sort(key=len)
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and (stop == at or size + len(new[stop]) <= 1 << 19):
                size += len(new[stop])
                stop += 1
            for s, ids in zip(new[at:stop], self.best_paths(new[at:stop])):
                self.cache[s] = ids
            at = stop

    def edges(self, data: np.ndarray, starts: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces that begin at the given places and end by ``stop``, by walking the trie."""
        trie = self.trie
        found = []
        place, state, limit, begin = starts.copy(), np.zeros(len(starts), np.int32), stop, starts
        while len(place):
            to = trie.base[state] + data[place] + 1
            ok = trie.check[to] == state
            begin, state, limit, place = begin[ok], to[ok], limit[ok], place[ok] + 1
            piece = trie.value[state]
            hit = piece >= 0
            found.append((begin[hit], place[hit], piece[hit]))
            more = place < limit
            begin, state, limit, place = begin[more], state[more], limit[more], place[more]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (starts[:0],) * 3

    def best_paths(self, segments: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of the best path of each segment."""
        coded = [s.encode("utf-8", "surrogatepass") for s in segments]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int32)
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        owner = np.searchsorted(ends, heads, "right")
        a, b, piece = self.edges(data, heads, ends[owner])
        # one unknown edge for each character without a piece of its own
        after = np.append(heads[1:], len(data))
        single = np.zeros(len(data) + 1, bool)
        rank = np.searchsorted(heads, a)
        single[a[after[rank] == b]] = True
        lone = ~single[heads]
        a, b = np.concatenate([a, heads[lone]]), np.concatenate([b, after[lone]])
        piece = np.concatenate([piece.astype(np.int64), np.full(int(lone.sum()), -1)])
        gain = np.where(piece >= 0, self.score[piece], self.unknown_score)
        # nodes: byte places, with one more in front of each segment
        seg = np.searchsorted(ends, a, "right")
        step = b - begins[seg]
        order = np.lexsort((a, b, step))
        a, b, piece, gain, seg, step = (x[order] for x in (a, b, piece, gain, seg, step))
        best = np.full(len(data) + len(sizes) + 1, -np.inf)
        came = np.zeros(len(best), np.int64)
        source, target = a + seg, b + seg
        best[begins + np.arange(len(sizes))] = 0.0
        edges = np.flatnonzero(np.diff(step, prepend=-1)) if len(step) else np.empty(0, np.int64)
        for low, high in zip(edges, np.append(edges[1:], len(step))):
            reach = best[source[low:high]] + gain[low:high]
            first = np.flatnonzero(np.diff(target[low:high], prepend=-1))
            top = np.maximum.reduceat(reach, first)
            size = np.diff(np.append(first, high - low))
            hit = np.flatnonzero(reach == np.repeat(top, size))
            nth = np.searchsorted(hit, first)  # the first edge that reaches the top
            best[target[low + first]] = top
            came[target[low + first]] = low + hit[nth]
        where = ends + np.arange(len(sizes))
        floor = begins + np.arange(len(sizes))
        live = np.arange(len(sizes))
        segs, picks = [], []
        while len(live):
            edge = came[where[live]]
            segs.append(live)
            picks.append(edge)
            where[live] = source[edge]
            live = live[where[live] > floor[live]]
        segs, picks = np.concatenate(segs), np.concatenate(picks)
        order = np.argsort(segs, kind="stable")
        segs, picks = segs[order], picks[order]
        cuts = np.searchsorted(segs, np.arange(len(sizes) + 1))
        found = []
        for k in range(len(sizes)):
            path = picks[cuts[k] : cuts[k + 1]][::-1]
            ids = piece[path]
            if (ids < 0).any():
                whole: list[int] = []
                for edge, i in zip(path.tolist(), ids.tolist()):
                    if i >= 0:
                        whole.append(i)
                    elif self.byte_ids:
                        whole += [self.byte_ids[x] for x in data[a[edge] : b[edge]].tolist()]
                    else:
                        whole.append(self.unknown)
                ids = np.array(whole)
            found.append(ids.astype("<i4").tobytes())
        return found

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts; null and empty texts have none."""
        cut = [self.segments(t) if t else [] for t in texts]
        self.learn({s for own in cut for s in own})
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), "<i4") for own in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces joined, markers as spaces, without the marker in front."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, pieces: Pieces, with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, n_bytes (byte pieces), ids_crc32, score, restored (decoding gives the text back) and, if asked for, ids.

    score is the sum of the pieces' log scores, with byte pieces as one unknown each. Null and empty texts have
    no ids. A text that holds the whitespace marker itself isn't restored: the marker
    decodes to a space. Repeated rows are encoded each; other columns are ignored; an
    empty table gives no rows.
    """
    model = Unigram(pieces)
    is_byte = pieces.kind == BYTE
    schema = "doc_id long, n_ids long, n_bytes long, ids_crc32 long, score double, restored boolean" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.cache = {}
        for batch in batches:
            for at in range(0, len(batch), 400):
                part = batch.slice(at, 400)
                texts = part.column(1).to_pylist()
                ids = model.encode_batch(texts)
                byte = [int(is_byte[x].sum()) for x in ids]
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(byte, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([float(np.where(is_byte[x], model.unknown_score, model.score[x]).sum()) for x in ids]), pa.array([model.decode(x) == (t or "") for x, t in zip(ids, texts)])]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """``(doc_id, ids)`` to ``(doc_id, text)``; null ids give a null text."""
    model = Unigram(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
