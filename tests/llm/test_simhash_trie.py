import numpy as np
import pytest
import xxhash

from pulseloom.llm import simhash_trie as st


def brute_print(text):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(prints, ids):
    label = list(range(len(ids)))
    change = True
    while change:
        change = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= 2 and label[j] > label[i]:
                    label[j], change = label[i], True
    best = {}
    for i, l in zip(ids, label):
        best[l] = min(best.get(l, i), i)
    return [best[l] for l in label]


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two", "a b c", "Ä b\x0bC d e f g", "x y z " * 300])
def test_fingerprint(text):
    assert st.text_fingerprint(text) == brute_print(text)


def test_trie_join_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, near ^ np.uint64(2**63), [0, 1, 3, 2**64 - 1, 2**64 - 2]]).astype(np.uint64))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if np.bitwise_count(values[i] ^ values[j]) <= 2}
    for chunk in (7, 1 << 18):
        got = [(i, j) for a, b in st.trie_join(values, None, 2, chunk) for i, j in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want
    other = np.unique(values[::2] ^ np.uint64(5))
    want = {(i, j) for i in range(len(values)) for j in range(len(other)) if 1 <= np.bitwise_count(values[i] ^ other[j]) <= 2}
    assert {(i, j) for a, b in st.trie_join(values, other, 2) for i, j in zip(a.tolist(), b.tolist())} == want


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 40))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + [t.upper() for t in texts[:15]] + [None, "", "  ", "short", "SHORT"]
    ids = list(range(1000, 1000 + len(texts)))
    rows = [(i, t, "en", 7, "clash") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, fp int, component_id string")
    prints = [brute_print(t) for t in texts]
    want = brute_components(prints, ids)
    for node_rows in (50_000, 4):
        got = {r["doc_id"]: r for r in st.simhash_components(docs, node_rows=node_rows).collect()}
        assert [got[i]["component_id"] for i in ids] == want
        assert [got[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
        assert [got[i]["n_links"] for i in ids] == [sum(bin(p ^ q).count("1") <= 2 for q in prints) - 1 for p in prints]


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert st.simhash_components(docs).collect() == []
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in st.simhash_components(docs).collect()) == [(1, 1, 1), (1, 1, 1), (2, 2, 0)]


def test_every_rotation_and_tiles(spark):
    """Pairs that differ in given bits, whichever blocks these lie in, count once; by all pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = [(0, 1), (0, 30), (0, 63), (20, 21), (21, 42), (41, 42), (43, 62), (62, 63), (5, 5), (25, 25), (60, 60), (7, 33)]
    values = [int(b) for b in base] + [int(base[k]) ^ (1 << (63 - x)) ^ ((1 << (63 - y)) if x != y else 0) for k, (x, y) in enumerate(flips)]
    values += [int(base[30]) ^ (1 << k) for k in range(64)]  # a crowd: each pair of it within two bits
    values += values[-3:]
    rows = [(k, v - 2**64 if v >= 2**63 else v) for k, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    want = {v: sum(bin(v ^ w).count("1") in (1, 2) for w in values) for v in values}
    for node_rows in (50_000, 5):
        got = {r["fp"] % 2**64: r["links"] for r in st.near_classes(prints, node_rows=node_rows).collect()}
        assert got == want


def test_long_text():
    text = " ".join(f"w{k % 70_001}" for k in range(140_000))  # more hashes than one part of the vote
    assert st.text_fingerprint(text) == brute_print(text)
