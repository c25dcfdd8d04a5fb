import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pulseloom.llm import bpe, feistel_order as fo

BITS = [" ", " ", "\n", "\t", "a", "the", "'s", "don't", "23", ".", ",", "é", "Ж", "日", "\xa0", "\x1c", "\x85", bpe.SPECIAL, "😀", "\r\n", " of", "-", "\x00"]


def each(texts):
    return [x.tolist() for ids, sizes in bpe.encode_all(texts) for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("together", [200, 8 << 20])
def test_batches_have_the_ids_of_single_texts(monkeypatch, together, kind):
    monkeypatch.setattr(bpe, "_TOGETHER", together)
    rng = random.Random(3)
    texts = [None, "", " ", "a ", " a", "  ", "b\n a", "b\n", "\nb", *("".join(rng.choices(BITS, k=rng.randrange(30))) for _ in range(1500)), "word " * 400]
    exact = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    want = [exact.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole = pa.array(["before", *texts], kind)[1:]  # a slice, as batches may be
    assert each(whole) == want
    assert np.concatenate(list(bpe.count_all(whole))).tolist() == [len(x) for x in want]
    assert each(whole[:0]) == []


def test_a_repeated_word_is_encoded_once(monkeypatch):
    class Counting:
        def __init__(self, inner):
            self.inner, self.seen, self.max_token_value, self._core_bpe = inner, 0, inner.max_token_value, self

        def encode_to_numpy(self, text):
            self.seen += len(text)
            return self.inner.encode_to_numpy(text)

        def encode_ordinary(self, text):
            self.seen += len(text)
            return self.inner.encode_ordinary(text)

    counting = Counting(bpe._fast(bpe.vocabulary_path("byte_bpe_50k.tiktoken")))
    monkeypatch.setattr(bpe, "_fast", lambda path: counting)
    texts = [" ".join(f"word{(k * j) % 40}" for j in range(50)) for k in range(200)]
    blocks = list(fo._sequences(iter([pa.RecordBatch.from_pydict({"text": texts})]), "byte_bpe_50k", 64, fo.END_ID))
    assert 0 < counting.seen < sum(map(len, texts)) / 20
    stream = np.concatenate([x for t in texts for x in (counting.inner.encode_to_numpy(t), [fo.END_ID])])
    assert (np.concatenate(blocks).reshape(-1)[: len(stream)] == stream).all()
