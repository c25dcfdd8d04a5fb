import numpy as np
from tokenizers import Tokenizer

from pulseloom.llm import bpe, length_histogram as lh


def test_against_direct_counts(spark):
    texts = [None, "", "a", "a b c d e", "a b c d e", "word " * 3000, "für " * 700] + [f"n {k} " * k for k in range(80)]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, length int")
    exact = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    n = np.array([len(exact.encode(t or "").ids) for t in texts])
    hist = lh.length_counts(docs)
    sums = lh.suffix_sums(hist, block=16)
    rows = sums.collect()
    assert {r["length"]: r["n_docs"] for r in rows} == dict(zip(*map(list, map(np.ndarray.tolist, np.unique(n, return_counts=True)))))
    for r in rows:
        k = r["length"]
        assert (r["docs_ge"], r["tokens_ge"]) == ((n >= k).sum(), n[n >= k].sum())
        assert (r["docs_total"], r["tokens_total"], r["truncated_total"]) == (len(n), n.sum(), np.minimum(n, k).sum())
        assert r["share_le"] == (n <= k).mean()
    for r in lh.at_limits(sums, [1, 7, 100, 10**6]).collect():
        k = r["context_limit"]
        assert (r["docs_over"], r["truncated_total"], r["tokens_lost"]) == ((n > k).sum(), np.minimum(n, k).sum(), np.maximum(n - k, 0).sum())
    for r in lh.quantiles(sums, [0.0, 0.5, 1.0]).collect():
        assert r["length"] == np.sort(n)[max(0, int(np.ceil(r["share"] * len(n))) - 1)]


def test_empty(spark):
    hist = lh.length_counts(spark.createDataFrame([], "text string"))
    assert hist.collect() == [] and lh.suffix_sums(hist).collect() == []
    assert [tuple(r) for r in lh.at_limits(lh.suffix_sums(hist), [5]).collect()] == [(5, 0, 0, 0)]
