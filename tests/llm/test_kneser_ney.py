import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulseloom.llm import kneser_ney as kn


def brute_model(texts, order):
    """Probabilities by plain dictionaries."""
    seqs = [["<"] * (order - 1) + (t or "").encode().lower().split() + [">"] for t in texts]
    raw = Counter(w for s in seqs for w in s[order - 1 :])
    tables = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    disc, ctx = {}, {}
    for k, t in tables.items():
        cc = Counter(t.values())
        disc[k] = [0.0, *kn.discounts(np.array([cc[1], cc[2], cc[3], cc[4]], float))]
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][1] += disc[k][min(c, 3)]
    v = len(raw)

    def prob(history, w):
        p = 1 / (v + 1)
        for k in range(1, order + 1):
            h = tuple(history[len(history) - k + 1 :])
            if h in ctx[k]:
                total, rest = ctx[k][h]
                c = tables[k].get(h + (w,), 0)
                p = max(c - disc[k][min(c, 3)], 0) / total + rest / total * p
        return p

    return raw, prob


def corpus(n=150, seed=4):
    rng = np.random.default_rng(seed)
    vocab = [f"Wort{i}é" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    return [" ".join(rng.choice(vocab, int(rng.integers(0, 40)), p=weights / weights.sum())) for _ in range(n)] + ["the " * 700, None, "", " \n\t\x0b", "x" * 50_000, "The THE the"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_brute_force(spark, order):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(3, texts[3], 1.0)], "doc_id long, text string, score double")
    ids = list(range(len(texts))) + [3]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    raw, prob = brute_model([texts[i] for i, h in zip(ids, out) if not h], order)
    n, v = sum(raw.values()), len(raw)
    got = kn.score_documents(docs, order).collect()
    assert len(got) == len(ids)
    for r in got:
        words = (texts[r["doc_id"]] or "").encode().lower().split() + [">"]
        seq = ["<"] * (order - 1) + words
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in raw for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((raw[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(prob(seq[:i], seq[i])) for i in range(order - 1, len(seq))), rel=1e-9)
    for history in (["<"], [raw.most_common(1)[0][0]]):
        total = sum(prob(["<"] * order + history, w) for w in [*raw, None])
        assert total == pytest.approx(1)


def test_hot_words(spark):
    texts = corpus()
    words = [w for t in texts for w in [*(t or "").encode().lower().split(), None]]
    counts = Counter(words)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = sorted(int(kn.END) if w is None else int(kn.hashes_of([w.decode()], 1)[0][0]) for w, n in counts.items() if n >= len(words) / 64)
    assert [int(x) for x in kn.hot_words(frame, 1 / 64)] == want and len(want) > 5
    assert len(kn.hot_words(frame.limit(0), 1 / 64)) == 0


def test_common_words_are_split_alike(spark, monkeypatch):
    """The same scores whether hot words are set apart or not."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    found = []
    for share in (1 / 64, 2.0):
        monkeypatch.setattr(kn, "hot_words", lambda texts, _, share=share, real=kn.hot_words: real(texts, share) if share < 1 else np.empty(0, np.uint64))
        found.append({r["doc_id"]: r["score"] for r in kn.score_documents(docs, 3).collect()})
        monkeypatch.undo()
    assert found[0] == pytest.approx(found[1], rel=1e-12)


def test_sorted_arrays():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 31, 32, 5000):
        gram = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        files = kn._grams_as_files(gram)
        asked = np.concatenate([gram, rng.integers(0, 2**64, 500, dtype=np.uint64)])
        if len(gram):
            rows, places = kn._find(files["low"], files["start"], asked)
            assert rows.tolist() == list(range(len(gram))) and places.tolist() == list(range(len(gram)))
        assert files["start"][-1] == len(gram)


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 2**64, 50, dtype=np.uint64)[rng.integers(0, 50, 999)] for _ in range(3)]
    value = rng.integers(0, 2**40, 999)
    back, (got,) = kn.unpack(kn.pack(columns, [value]))
    order = np.lexsort(columns[::-1])
    assert all((a[order] == b).all() for a, b in zip(columns, back)) and (value[order] == got).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert kn.score_documents(docs).collect() == []
    one = spark.createDataFrame([(i, "a") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    rows = kn.score_documents(one).collect()
    assert rows and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 and r["held_out"] for r in rows)


def test_query_scores_by_longer_contexts(spark, tmp_path):
    from pulseloom.llm import queries

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], 12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    _, prob = brute_model([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for r in queries.op4_kneser_ney(spark, str(tmp_path)).collect():
        seq = ["<", "<", *texts[r["doc_id"]].encode().split(), ">"]
        assert r["score"] == pytest.approx(sum(math.log10(prob(seq[:i], seq[i])) for i in range(2, len(seq))), rel=1e-9)


def test_disk_of_shuffle_and_model(spark, tmp_path, monkeypatch):
    """Trigrams are sent as numbers, without hashes in every block; a context with one n-gram seen once takes no room."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.zipf(1.3, 400), 9_000)) for _ in range(150)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    sent = []

    def measured(blocks, order, *rest, real=kn.merge_shards):
        if order == 3:
            sent.append(sum(len(r["block"]) for r in blocks.collect()))
        return real(blocks, order, *rest)

    monkeypatch.setattr(kn, "merge_shards", measured)
    model = kn.train(frame, 3, 6, str(tmp_path))
    size = lambda stem: sum(f.stat().st_size for f in tmp_path.glob(f"{stem}-*"))
    assert model.numbers[3][5] > 20_000 and sent[0] < 7 * model.numbers[3][5]
    assert 0 < size("c3") < size("n2") + size("hn2")


def test_contexts_seen_once_and_never(spark):
    """Contexts with one n-gram seen once aren't listed; they, start marks and unknown contexts give the probabilities of dictionaries."""
    train = ["a b c d", "e f g", "a b d", "", "e f g h i"]
    asked = [*train, "a b", "b c d", "f g", "zz a b c", "a zz b c d", "g", "h i e f", None]
    for texts in (train, train[:1]):
        model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
        _, prob = brute_model(texts, 3)
        got = kn.score_texts(spark.createDataFrame(list(enumerate(asked)), "k long, text string").select("text", "k"), model, "k").collect()
        assert len(got) == len(asked)
        for r in got:
            seq = ["<", "<", *(asked[r["k"]] or "").encode().split(), ">"]
            assert r["score"] == pytest.approx(sum(math.log10(prob(seq[:i], seq[i])) for i in range(2, len(seq))), rel=1e-9)


def test_sorting_and_ranking():
    rng = np.random.default_rng(5)
    close = np.uint64(2**63) + rng.integers(0, 50, 999, dtype=np.uint64)  # decided by the bits that hold places
    for key in (rng.integers(0, 2**64, 5000, dtype=np.uint64), close, np.empty(0, np.uint64), np.full(7, 2**64 - 1, np.uint64)):
        assert (key[kn.ascending(key)] == np.sort(key)).all()
        every, place = kn.ranked(key)
        assert (every == np.unique(key)).all() and (every[place] == key).all()
    for values, width in ((40, 3), (2**30, 3), (40, 1)):
        columns = [rng.integers(0, 40, 3000) * (values // 40) for _ in range(width)]
        rows, counts = kn.distinct_rows(columns, values)
        want, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        assert (np.stack(rows, 1) == want).all() and (counts == n).all()


def test_cuts():
    assert kn.cuts(np.array([3, 3, 3, 50, 1, 0, 9, 2]), 10) == [(0, 3), (3, 4), (4, 7), (7, 8)]
    assert kn.cuts(np.array([], np.int32), 10) == [] and kn.cuts(np.array([99]), 10) == [(0, 1)]


def test_hashes_with_the_same_32_bits():
    """Neighbours that differ only in later bits are told apart, and from hashes that aren't there."""
    rng = np.random.default_rng(2)
    for n in (20, 5000):
        gram = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        bits = kn.bucket_bits(len(gram))
        step = np.uint64(1 << (16 - min(bits, 15)))
        gram = np.unique(np.concatenate([gram, gram[::3] ^ step, gram[::3] ^ (step << np.uint64(1))]))
        files = kn._grams_as_files(gram)
        assert len(files["start"]) - 1 == 1 << kn.bucket_bits(len(gram))
        absent = np.setdiff1d(gram[::2] ^ (step << np.uint64(2)), gram)
        rows, places = kn._find(files["low"], files["start"], np.concatenate([gram, absent]), files["more"])
        assert rows.tolist() == list(range(len(gram))) and places.tolist() == list(range(len(gram)))


def test_more_shards_than_open_files(spark, tmp_path, monkeypatch):
    """A worker may open fewer files than the model has; the scores are those of a few shards, also where the files are too many to stay mapped, and from a store that can't be mapped."""
    import os
    import resource

    from pyarrow import fs

    texts = corpus()
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    few = kn.Arrays(kn.train(frame, 3, 3, f"{tmp_path}/few")).score(texts)
    model = kn.train(frame, 3, 7, f"{tmp_path}/many")
    assert len(model.hot) and len(list((tmp_path / "many").iterdir())) > 300
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 30, hard))
    try:
        found = [kn.Arrays(model).score(texts)]
        monkeypatch.setattr(kn, "MOST_MAPS", 150)
        found.append(kn.Arrays(model).score(texts))
        monkeypatch.setattr(kn, "MOST_MAPS", 1)
        found.append(kn.Arrays(model).score(texts))
        monkeypatch.undo()
        monkeypatch.setattr(kn, "local_or_fs", lambda path: (fs.SubTreeFileSystem(path, fs.LocalFileSystem()), ""))
        found.append(kn.Arrays(model).score(texts))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    for got in found:
        assert all((a == b).all() for a, b in zip(got[:2], few[:2]))
        assert got[2] == pytest.approx(few[2], rel=1e-12) and got[3] == pytest.approx(few[3], rel=1e-12)
