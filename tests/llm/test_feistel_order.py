import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pulseloom.llm import bpe, feistel_order as fo


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_permutation_and_inverse(n):
    slots = fo.permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert fo.invert(slots, n, 7).tolist() == list(range(n))
    if n > 100:
        assert (slots != fo.permute(np.arange(n), n, 8)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15


def test_shards_hold_the_stream(spark, tmp_path):
    texts = [None, "", "short", "word " * 900, "Ünï " * 500, "a", "a"] + [f"doc {k} " * (k % 13) for k in range(60)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, slot int").coalesce(1)
    out = f"file://{tmp_path}/shards"
    rows = sorted(fo.materialise(docs, out, key=5, tokens=64, per_shard=7).collect(), key=lambda r: r["sequence"])
    exact = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    stream = [x for t in texts for x in exact.encode(t or "").ids + [fo.END_ID]]
    stream += [fo.END_ID] * (-len(stream) % 64)
    want = np.array(stream, "<u2").reshape(-1, 64)
    assert [r["sequence"] for r in rows] == list(range(len(want)))
    assert sorted(r["slot"] for r in rows) == list(range(len(want)))
    for r in rows:
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // 7, r["slot"] % 7 * 128)
        assert r["ids_crc32"] == zlib.crc32(want[r["sequence"]].tobytes())
    order = fo.invert(np.arange(len(want)), len(want), 5)
    assert (fo.read_slots(out, 0, len(want) + 9, 7, 64) == want[order]).all()
    assert (fo.read_slots(out, 10, 9, 7, 64) == want[order[10:19]]).all()
    assert len(fo.read_slots(out, len(want), 3, 7, 64)) == 0


def test_empty_and_many_partitions(spark, tmp_path):
    assert fo.materialise(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), cast(id % 50 AS int)) AS text").repartition(5)
    docs = docs.sort("doc_id")
    found = set()
    for share in (0.0, 0.5, 1.0):
        rows = fo.materialise(docs, f"{tmp_path}/s{share}", tokens=32, shards=3, stored_share=share).collect()
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        found.add(tuple(sorted((r["slot"], r["sequence"], r["ids_crc32"]) for r in rows)))
    assert len(found) == 1


def test_wide_ids_fail(spark, monkeypatch):
    with pytest.raises(ValueError):
        fo.materialise(spark.createDataFrame([(1, "a")], "doc_id long, text string"), end_id=70_000)
    monkeypatch.setattr(bpe, "encode", lambda text, vocabulary: np.array([70_000], np.uint32))
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    with pytest.raises(ValueError):
        list(fo._sequences(iter([batch]), "any", 8, 0))


def test_one_very_long_text(spark, tmp_path):
    text = "word and " * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = fo.materialise(docs, f"{tmp_path}/long", tokens=64, per_shard=100).collect()
    n = len(bpe.encode(text)) + 1
    assert len(rows) == -(-n // 64)
    got = fo.read_slots(f"{tmp_path}/long", 0, len(rows), 100, 64)
    order = fo.invert(np.arange(len(rows)), len(rows), 42)
    assert (got.reshape(len(rows), 64)[np.argsort(order)].reshape(-1)[: n - 1] == bpe.encode(text)).all()
