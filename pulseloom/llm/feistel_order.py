"""Training order as files: a keyed permutation of sequences, written as fixed-stride shards.

1. Workers encode each input partition as a stream of ids (documents joined by an end
   id) and cut it into sequences of one length. A share of the partitions stores its
   sequences in compressed blocks; the others only report how many there are.
2. Sums over the counts give every sequence a number in 0..N-1 and the size of the
   permutation's domain.
3. Sequences, read back or encoded again, are sent to their slots, ``permute(number)``: a
   Feistel network over the next even number of bits, walked along its cycle until it
   lands below N.
4. Slots are dealt to range partitions by arithmetic, sorted, and written: shard k holds
   slots k*per_shard.. in fixed strides, so slot s starts at byte (s % per_shard) * stride.

The share that is stored trades disk for computing: all of it saves a second encoding, none
saves about the input's size on disk. A partition that is encoded again is checked by
count and digest against the first time, so an input that reads differently fails instead
of writing a wrong order. Files are written under a temporary name and renamed: a repeated
task writes the same bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm import bpe
from pulseloom.llm.store import fresh_path, local_or_fs, stored

END_ID = 50256
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(key: int, rounds: int = ROUNDS) -> np.ndarray:
    steps = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(steps + np.uint64(key % 2**64))


def _half_bits(n: int) -> int:
    return max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the given numbers under the keyed permutation of 0..n-1."""
    return _walk(numbers, n, key, forward=True)


def invert(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """Numbers of the given slots."""
    return _walk(slots, n, key, forward=False)


def _walk(values: np.ndarray, n: int, key: int, forward: bool) -> np.ndarray:
    bits = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    keys = round_keys(key)
    out = np.asarray(values).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys if forward else keys[::-1]:
            if forward:
                left, right = right, left ^ (_mix(right + k) & mask)
            else:
                left, right = right ^ (_mix(left + k) & mask), left
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], vocabulary: str, tokens: int, end_id: int) -> Iterator[np.ndarray]:
    """Whole sequences of a partition's stream as rows of 16-bit ids; the last is filled with the end id."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for ids, sizes in bpe.encode_all(batch.column(0), vocabulary):
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id takes more than the 16 bits of a shard's strides")
            ids = np.insert(ids.astype("<u2"), np.cumsum(sizes), end_id)
            held.append(ids)
            size += len(ids)
            if size >= 256 * tokens:
                stream = np.concatenate(held)
                full = size // tokens * tokens
                for at in range(0, full, 256 * tokens):
                    yield stream[at : min(at + 256 * tokens, full)].reshape(-1, tokens)
                held, size = [stream[full:]], size - full
    if size:
        stream = np.concatenate(held)
        yield np.append(stream, np.full(-size % tokens, end_id, "<u2")).reshape(-1, tokens)


def materialise(docs: DataFrame, out_dir: str | None = None, key: int = 42, tokens: int = 1024, per_shard: int | None = None, shards: int | None = None, stored_share: float = 0.5, vocabulary: str = bpe.DEFAULT_VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write all texts in training order; one row for each sequence.

    Returns slot, sequence (its number in input order), shard, byte_offset, n_tokens (of
    the stride, end ids included) and ids_crc32 (of the stride's bytes). Running the
    result writes the shards to ``out_dir`` (``shard-<k>.bin`` of 16-bit little-endian
    ids; default: a new folder in the shared one). A null text is an end id alone;
    repeated rows are written as often; other columns are ignored; an empty table gives
    no rows and no files. An id of 65,536 or more raises ValueError.
    """
    if end_id > 0xFFFF:
        raise ValueError("an id takes more than the 16 bits of a shard's strides")
    spark = docs.sparkSession
    out_dir = out_dir or fresh_path(spark, "shards")
    # the partition's own number: a task's differs from it below a union
    texts = docs.select(F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, Iterator[pa.RecordBatch]]:
        for batch in batches:
            if len(batch):
                return batch.column(1)[0].as_py(), chain([batch], batches)
        return None, iter(())

    def digested(batches: Iterator[pa.RecordBatch], seen: list[int]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    seen[0] = zlib.crc32(text.as_buffer(), seen[0])
                seen[0] = zlib.crc32(b"\0" if text.is_valid else b"\1", seen[0])
            yield batch

    def keeps(part: int) -> bool:
        return int((part + 1) * stored_share) > int(part * stored_share)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = 0, [0]
        part, batches = numbered(batches)
        if part is None:
            return
        texts = digested(batches, seen)
        row = lambda at, n, digest, ids: pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at]), pa.array([n]), pa.array([digest]), pa.array([ids], pa.binary())], names=["part", "at", "n", "digest", "ids"])
        if keeps(part):
            for block in _sequences(texts, vocabulary, tokens, end_id):
                yield row(at, len(block), 0, zstandard.ZstdCompressor(level=3).compress(block))
                at += len(block)
        else:
            n = sum(int(sizes.sum()) + len(sizes) for batch in texts for sizes in bpe.count_all(batch.column(0), vocabulary))
            if n:
                yield row(0, -(-n // tokens), seen[0], None)

    blocks = stored(texts.mapInArrow(first, "part long, at long, n long, digest long, ids binary"), "sequences")
    counts = blocks.groupBy("part").agg(F.sum("n").alias("n"), F.max("digest").alias("digest")).collect()  # one row for each input partition
    total = sum(r["n"] for r in counts)
    stride = 2 * tokens
    if per_shard is None:
        per_shard = max(1, -(-total // (shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    n_shards = max(1, -(-total // per_shard))
    bases, at = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        bases[r["part"]] = (at, r["n"], r["digest"])
        at += r["n"]

    def placed(block: np.ndarray, number: int) -> pa.RecordBatch:
        numbers = np.arange(number, number + len(block), dtype=np.int64)
        slots = permute(numbers, total, key)
        return pa.RecordBatch.from_arrays([pa.array(slots // per_shard, pa.int32()), pa.array(slots), pa.array(numbers), pa.array([x.tobytes() for x in block], pa.binary())], names=["shard", "slot", "sequence", "ids"])

    def from_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, ids in zip(*batch.columns):
                block = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids.as_buffer()), "<u2").reshape(-1, tokens)
                yield placed(block, bases[part.as_py()][0] + at.as_py())

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = numbered(batches)
        if part is None or keeps(part):
            return
        base, n, want = bases.get(part, (0, 0, 0))
        done, seen = 0, [0]
        for block in _sequences(digested(batches, seen), vocabulary, tokens, end_id):
            if done + len(block) > n:
                break
            yield placed(block, base + done)
            done += len(block)
        if (done, seen[0]) != (n, want):
            raise RuntimeError("an input partition read differently the second time; store the documents first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = target = temporary = system = None
        try:
            for batch in batches:
                slots, shard = batch.column(1).to_numpy(), batch.column(0)
                crcs = []
                for k, ids in enumerate(batch.column(3)):
                    if sink is None:
                        system, folder = local_or_fs(out_dir)
                        system.create_dir(folder, recursive=True)
                        target = f"{folder}/shard-{shard[k].as_py():06d}.bin"
                        temporary = f"{folder}/_{shard[k].as_py():06d}-{TaskContext.get().taskAttemptId()}"
                        sink = system.open_output_stream(temporary)
                    raw = ids.as_buffer()
                    sink.write(raw)
                    crcs.append(zlib.crc32(raw))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), shard, pa.array(slots % per_shard * stride), pa.array(np.full(len(slots), tokens, np.int32)), pa.array(crcs, pa.int64())], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32"])
        finally:
            if sink is not None:
                sink.close()
        if sink is not None:
            system.move(temporary, target)

    schema = "shard int, slot long, sequence long, ids binary"
    sent = blocks.where("ids IS NOT NULL").select("part", "at", "ids").mapInArrow(from_blocks, schema).unionByName(texts.mapInArrow(from_texts, schema))
    # one shard a partition; Spark sorts each on disk where it must
    ranged = sent.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot")
    return ranged.mapInArrow(write, "slot long, sequence long, shard int, byte_offset long, n_tokens int, ids_crc32 long")


def read_slots(out_dir: str, first: int, count: int, per_shard: int, tokens: int = 1024) -> np.ndarray:
    """Sequences of slots first..first+count-1 (fewer at the end), read in order from any point."""
    stride, found = 2 * tokens, []
    system, folder = local_or_fs(out_dir)
    while count > 0:
        path = f"{folder}/shard-{first // per_shard:06d}.bin"
        if system.get_file_info(path).size is None:
            break
        with system.open_input_file(path) as shard:
            shard.seek(first % per_shard * stride)
            raw = shard.read(min(count, per_shard - first % per_shard) * stride)
        if not raw:
            break
        found.append(np.frombuffer(raw, "<u2").reshape(-1, tokens))
        first, count = first + len(found[-1]), count - len(found[-1])
    return np.concatenate(found) if found else np.empty((0, tokens), "<u2")
