import numpy as np
import pytest

import corpus_pipeline
from pulseloom.llm import shingle_sets


def brute_set(text):
    tokens = (text or "").encode().lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(len(tokens) - 4, 1))} if tokens else set()


def brute_kept(rows):
    sets = [brute_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        order = (r[0] is None, r[0] or 0)
        best[root(i)] = min(best.get(root(i), order), order)
    return sorted(best.values())


def corpus(seed=5):
    rng = np.random.default_rng(seed)
    vocab = [f"word{i}" for i in range(3000)]
    texts = []
    for k in range(120):
        own = list(rng.choice(vocab, int(rng.integers(1, 250))))
        texts.append(" ".join(own))
        for changes in (1, 2, 4) if k % 2 else ():
            copy = list(own)
            for at in rng.integers(0, len(own), changes):
                copy[at] = str(rng.choice(vocab))
            texts.append(" ".join(copy).upper())
    hot = list(rng.choice(vocab, 100))
    for _ in range(150):
        copy = list(hot)
        copy[int(rng.integers(0, 100))] = str(rng.choice(vocab))
        texts.append(" ".join(copy))
    texts += [None, "", " \n", "one two three four", "One two  three four", texts[0], texts[-1]]
    return [(int(i), t, "x") for i, t in zip(rng.permutation(len(texts)), texts)] + [(None, texts[3], "x"), (None, "nothing like it", "x")]


@pytest.mark.parametrize("small, seat", [(512, 4096), (2, 3)])
def test_stage_against_all_pairs(spark, monkeypatch, small, seat):
    """With limits so low that groups are compared in tiles, too."""
    monkeypatch.setattr(shingle_sets, "SMALL", small)
    monkeypatch.setattr(shingle_sets, "SEAT", seat)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = brute_kept(rows)
    assert len(want) < 0.6 * len(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == want


def test_a_shared_passage_takes_few_rounds(spark, monkeypatch):
    """A crowd of texts that share half of their words, none similar to another: rounds don't follow its size."""
    rng = np.random.default_rng(3)
    passage = [f"common{k}" for k in range(60)]
    rows = [(k, " ".join([*passage, *(f"own{k}x{j}" for j in range(40))]), "x") for k in range(150)]
    rows += [(1000 + k, rows[k][1] + " end", "x") for k in range(20)]
    docs = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "doc_id long, text string, source string")
    calls = []
    monkeypatch.setattr(shingle_sets, "_verify", lambda *args, real=shingle_sets._verify: calls.append(1) or real(*args))
    assert sorted(r["doc_id"] for r in shingle_sets.keep_one(docs).collect()) == list(range(150))
    assert len(calls) <= 2


def chain(rng, length, words=100, step=4):
    """Texts that each differ from the one before in so many words: neighbours are similar, others after a few steps aren't."""
    text, out = [f"c{v}" for v in rng.integers(0, 10**9, words)], []
    for _ in range(length):
        out.append(" ".join(text))
        text = [*text[step:], *(f"c{v}" for v in rng.integers(0, 10**9, step))]
    return out


@pytest.mark.parametrize("small", [256, 4])
def test_chains_stay_whole(spark, monkeypatch, small):
    monkeypatch.setattr(shingle_sets, "SMALL", small)
    rng = np.random.default_rng(12)
    texts = [t for _ in range(8) for t in chain(rng, 30)]
    rows = [(int(k), t, "x") for k, t in zip(rng.permutation(len(texts)), texts)]
    got = shingle_sets.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((False, r["doc_id"]) for r in got.collect()) == brute_kept(rows) and got.count() == 8


@pytest.mark.parametrize("size", [5, 12, 40, 150, 600])
def test_signatures_lose_no_similar_pair(size):
    rng = np.random.default_rng(size)
    for _ in range(300):
        away = size // 10
        one = rng.integers(0, 2**63, size + away, dtype=np.int64).astype(np.uint64)
        sets = [np.sort(one[: size]), np.sort(one[away:])]
        if size - away >= 0.8 * (size + away):
            signs = np.stack([np.frombuffer(shingle_sets.signature(shingle_sets.least_hashes(x)), np.uint8) for x in sets])
            assert shingle_sets.may_link(signs, np.array([size, size]), np.array([1, 2]), 0.8).all()
    far = [np.sort(np.concatenate([one[: size // 2], rng.integers(0, 2**63, size - size // 2, dtype=np.int64).astype(np.uint64)])) for _ in range(20)]
    signs = np.stack([np.frombuffer(shingle_sets.signature(shingle_sets.least_hashes(x)), np.uint8) for x in far])
    assert size < 150 or not shingle_sets.may_link(signs, np.full(20, size), np.arange(20), 0.8).any()


def test_forests_among_sets_connect_what_all_pairs_do():
    rng = np.random.default_rng(13)
    for _ in range(20):
        base = [np.unique(rng.integers(0, 400, 40)) for _ in range(6)]
        sets = [np.setdiff1d(b, rng.choice(b, int(rng.integers(0, 8)), replace=False)) for b in base for _ in range(6)]
        roots = list(range(len(sets)))
        roots[3], roots[20] = 0, 1

        def classes(pairs):
            up = list(range(len(sets)))

            def top(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in [*pairs, (3, 0), (20, 1)]:
                up[top(a)] = top(b)
            return [top(k) for k in range(len(sets))]

        every = [(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
        found = shingle_sets.links_among(list(range(len(sets))), roots, sets, 0.8)
        assert {(a, b) for a, b in found} <= {(b, a) for a, b in every}
        want, got = classes(every), classes(found)
        assert all((want[a] == want[b]) == (got[a] == got[b]) for a in roots for b in roots)


def test_bands_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    for k in range(600):
        n = int(rng.integers(9, 400))
        changed = n // 9  # of n + changed shingles in all, n - changed are common
        one = rng.integers(0, 2**64, n + changed, dtype=np.uint64)
        a, b = np.sort(one[:n]), np.sort(one[changed:])
        assert n - changed >= 0.8 * (n + changed) - 1e-9
        met += bool(set(zip(range(25), shingle_sets.bands_of(shingle_sets.least_hashes(a)))) & set(zip(range(25), shingle_sets.bands_of(shingle_sets.least_hashes(b)))))
    assert met >= 597


def test_empty(spark):
    assert shingle_sets.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []
