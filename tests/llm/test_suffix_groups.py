import numpy as np
import pytest

from pulseloom.llm import queries, suffix_groups as sg


def brute(rows, window):
    """(doc_id, words, removed, kept) by a dictionary of all windows."""
    import re

    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, order(d)), order(d))
    out = []
    for d, words in split:
        off = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < order(d):
                off[i : i + window] = [True] * window
        out.append((d, len(words), sum(off), " ".join(w for w, x in zip(words, off) if not x)))
    return sorted(out, key=lambda r: (order(r[0]), r))


def same(spark, rows, window=8, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, h int").repartition(3)
    got = sg.without_repeats(df, window, **options).collect()
    found = sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], key=lambda r: ((r[0] is None, r[0] or 0), r))
    assert found == brute(rows, window)
    for r in got:
        assert r["n_removed"] == sum(b - a for a, b in zip(r["removed"][::2], r["removed"][1::2]))


def passages(seed, n=60):
    rng = np.random.default_rng(seed)
    say = lambda k: [f"w{v}" for v in rng.integers(0, 40, k)]
    shared = [say(k) for k in (7, 8, 9, 30, 200)]
    rows = []
    for d in rng.permutation(n).tolist():
        words = say(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 3))):
            p = shared[rng.integers(0, 5)]
            lo = int(rng.integers(0, max(1, len(p) - 12)))
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = p[lo:]
        rows.append((d, "\n".join([" ".join(words[:20]), "\t".join(words[20:])])))
    return rows


@pytest.mark.parametrize("seed, gram, most, bin_words", [(1, 3, 4096, 10**6), (2, 8, 4096, 40), (3, 1, 2, 10**6), (4, 5, 0, 10**6)])
def test_against_brute_force(spark, seed, gram, most, bin_words):
    rows = passages(seed)
    rows += [(d + 1000, t) for d, t in rows[:10]] + [rows[0], rows[1], (rows[2][0], rows[3][1])]  # copies, repeated rows, an id with two texts
    same(spark, rows, gram=gram, most=most, bin_words=bin_words)


def test_blanks_repeats_within_and_odd_rows(spark):
    line = "a b c d e f g h i"
    rows = [(5, f"{line} {line}"), (2, None), (3, ""), (4, " \n\t"), (None, line), (None, f"x {line}"), (7, line), (-4, f"y {line} z"), (9, "short one")]
    rows += [(20, "a " * 3000), (21, "a " * 2500 + "b"), (22, "a\x1cb \x85 c d e\xa0f " * 5), (19, "a\x1cb \x85 c d e\xa0f " * 5), (30, "日本 語 é " * 30), (31, "é 日本 語 " * 30)]
    same(spark, rows, gram=3)
    assert sg.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_long_text_and_a_hot_line(spark):
    rng = np.random.default_rng(7)
    line = " ".join(f"l{k}" for k in range(12))
    rows = [(d, " ".join(f"r{v}" for v in rng.integers(0, 10**6, 30)) + " " + line + " " + " ".join(f"s{v}" for v in rng.integers(0, 10**6, 30))) for d in range(300)]
    long = " ".join(f"t{v}" for v in rng.integers(0, 5000, 30_000))
    same(spark, [*rows, (1000, long), (999, "x " + long + " y")], window=10, gram=4, most=50)


def test_sorted_suffixes_and_common_lengths():
    rng = np.random.default_rng(8)
    for window in (1, 2, 5, 8, 13, 50):
        codes = rng.integers(0, 3, 400)
        starts = np.sort(rng.choice(400 - window, 150, replace=False))
        order, common = sg.sorted_suffixes(codes, starts, window)
        tuples = [tuple(codes[s : s + window]) for s in starts[order]]
        assert tuples == sorted(tuples)
        for k in range(1, len(order)):
            want = next((i for i in range(window) if tuples[k][i] != tuples[k - 1][i]), window)
            assert common[k] == want
        ids = rng.integers(0, 100, 150)
        least = sg.least_below(order, common, ids, window)
        for s, i in zip(starts, least):
            assert i == min(ids[k] for k, t in enumerate(starts) if tuple(codes[t : t + window]) == tuple(codes[s : s + window]))


def test_runs_of_words_have_keys_of_their_own():
    h = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    assert len(set(sg.pieces_of(h, 16, 16)[2].tolist())) == 4985
    starts, counts, keys = sg.pieces_of(h, 50, 16)
    assert 10 < counts.mean() < 26 and (sg.pieces_of(np.concatenate([h[:77], h]), 50, 16)[2][-50:] == keys[-50:]).all()


def test_pieces_cover_every_suffix_and_equal_windows_share_a_key():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 2**63, 3, dtype=np.int64).astype(np.uint64)[rng.integers(0, 3, 900)]
    starts, counts, keys = sg.pieces_of(h, 12, 4)
    assert starts[0] == 0 and (starts + counts)[-1] == 900 - 11 and (starts[1:] == (starts + counts)[:-1]).all()
    each, found = np.repeat(keys, counts), {}
    for i, k in enumerate(each):
        assert found.setdefault(h[i : i + 12].tobytes(), k) == k
    assert len(sg.pieces_of(h[:11], 12, 4)[0]) == 0


def test_query_against_brute_force(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op11_suffix_groups(spark, sf).collect())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute(rows, 50))
    assert got == want and sum(r[2] for r in want) > 0
