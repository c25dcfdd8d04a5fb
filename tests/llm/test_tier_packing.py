import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as s
from tokenizers import Tokenizer

from pulseloom.llm import bpe, tier_packing as tp


@settings(max_examples=60, deadline=None)
@given(s.lists(s.integers(1, 3000), max_size=60))
def test_every_token_once_and_sequences_full(lengths):
    packed = tp.pack_block(lengths)
    seen = [[] for _ in lengths]
    short = 0
    for tier, pieces in packed:
        total = sum(p[2] for p in pieces)
        assert 0 < total <= 1024 and all(p[2] > 0 for p in pieces)
        if total != tier:
            short += 1
            assert tier == 1024 and total < 128
        for doc, start, length in pieces:
            seen[doc].append((start, length))
    assert short <= 1
    for n, parts in zip(lengths, seen):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n


def test_step_groups_are_even():
    costs = [1024**2] * 8 + [100] * 56
    groups = tp.step_groups(costs, 16)
    assert max(np.bincount(groups)) <= 16
    assert max(sum(c for c, g in zip(costs, groups) if g == k) for k in set(groups)) <= 2.1 * 1024**2
    for n in (1, 63, 64, 65, 611):
        counts = np.bincount(tp.step_groups(list(range(n)), 64))
        assert counts.max() <= 64 and counts.max() - counts.min() <= 1
    assert tp.step_groups([], 64) == []


def test_tiers_last_and_few_documents_are_cut():
    rng = np.random.default_rng(0)
    lengths = (rng.lognormal(5.5, 1.0, 3000).astype(int) + 1).tolist()
    packed = tp.pack_block(lengths)
    tiers = np.array([t for t, _ in packed])
    assert all((tiers == t).mean() > 0.05 for t in tp.TIERS)
    pieces = np.bincount([p[0] for _, ps in packed for p in ps], minlength=len(lengths))
    short = np.array(lengths) < 1024
    assert (pieces[short] > 1).mean() < 0.03
    filled = [ps for t, ps in packed if t == 1024 and len(ps) > 1]
    assert all(ps[0][2] > 512 for ps in filled[:-1])  # a long window's own piece, then shorter ones


def test_rows_against_direct_encoding(spark):
    long = "Ünïcode wörds and numbers 12345 don't stop. " * 300
    texts = [None, "", " ", "a", "Hello world<|endoftext|>again", "日本語 テキスト", "x" * 5000, "very long " * 40_000, long, long, "͸\U0001fae8 odd"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(3, "a", "c")], "doc_id long, text string, offset string").coalesce(1)
    rows = tp.pack_documents(docs, with_ids=True).collect()
    exact = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    want = {k: np.array(exact.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t in enumerate(texts)}
    by_sequence = {}
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and part.tobytes() == bytes(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in rows) == sum(map(len, want.values())) + len(want[3])
    tiers = {}
    for r in rows:
        tiers.setdefault(r["step_group"], set()).add(r["tier"])
    assert all(len(t) == 1 for t in tiers.values())


def test_empty_table(spark):
    assert tp.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(s.text())
def test_encode_is_the_library_encoding(text):
    exact = bpe._exact(bpe.vocabulary_path("byte_bpe_50k.json"))
    assert bpe.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("low, high", [(0, 0x250), (0x391, 0x3CA), (0x410, 0x482), (0x2010, 0x205F), (0x3041, 0x30FB), (0x4E00, 0x4F00)])
def test_settled_characters(low, high):
    exact = bpe._exact(bpe.vocabulary_path("byte_bpe_50k.json"))
    for c in range(low, high):
        text = f"a{chr(c)} {chr(c)}1 \n{chr(c)}b"
        assert bpe.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_a_block_of_very_many_short_texts():
    import time

    began = time.perf_counter()
    done = tp.pack_block([1] * 1_000_000)
    assert time.perf_counter() - began < 20
    assert sum(p[2] for _, pieces in done for p in pieces) == 1_000_000 and sum(sum(p[2] for p in pieces) != tier for tier, pieces in done) <= 1
