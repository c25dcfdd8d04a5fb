import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as s

from pulseloom.llm import sentencepiece_unigram as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = sp.Pieces.load(PATH)
MODEL = sp.Unigram(PIECES)


def library():
    """The library's own Unigram encoder over the same pieces: the model type in the file's trainer settings is switched."""
    data = open(PATH, "rb").read()
    at = data.index(b"\x18\x02\x20\x80\xfa\x01")  # model type 2, 32,000 pieces
    return sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x18\x01" + data[at + 2 :])


LIBRARY = library()


def brute(text):
    """Plain Viterbi over characters."""
    known = {t: k for k, (t, kind) in enumerate(zip(PIECES.text, PIECES.kind)) if kind == sp.NORMAL}
    text = sp.MARK + text.replace(" ", sp.MARK) if text else ""
    best, came = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 16), j):
            part = text[i:j]
            gain = PIECES.score[known[part]] if part in known else MODEL.unknown_score if j == i + 1 else None
            if gain is not None and best[i] + gain > best[j]:
                best[j], came[j] = best[i] + gain, i
    out, j = [], len(text)
    while j:
        part = text[came[j] : j]
        out = ([known[part]] if part in known else [MODEL.byte_ids[x] for x in part.encode()]) + out
        j = came[j]
    return out


TEXTS = ["", " ", "a", "Hello world", "The cat sat on the mat.", "tab\tand\nnew\r\nlines", "Größe naïve œuvre", "日本語のテキスト", "\U0001f600 emoji 벨 ゼ", "x" * 700, "antidisestablishmentarianism " * 30, "▁odd", "0123456789 1e-9", "a" * 40 + " b" * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_against_library_and_brute_force(text):
    (ids,) = MODEL.encode_batch([text])
    assert ids.tolist() == brute(text)
    if text:  # the best of the library's lattice; of equally good paths it may take another
        (want, *_) = LIBRARY.nbest_encode(text, nbest_size=2)
        assert PIECES.score[ids].sum() == PIECES.score[want].sum() and MODEL.decode(np.array(want)) == MODEL.decode(ids)
    assert MODEL.decode(ids) == text.replace(sp.MARK, " ")


@settings(max_examples=150, deadline=None)
@given(s.text(alphabet=s.characters(exclude_categories=["Cs"], exclude_characters="▁\0"), max_size=60))
def test_round_trip_and_brute_force(text):
    (ids,) = MODEL.encode_batch([text])
    assert ids.tolist() == brute(text)
    assert MODEL.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(s.lists(s.text(alphabet="abcdefgéß,. \n", max_size=8), max_size=30))
def test_double_array(words):
    keys = {w.encode(): k for k, w in enumerate(words) if w}
    trie = sp.DoubleArray(keys)

    def find(word):
        state = 0
        for b in word:
            to = trie.base[state] + b + 1
            if to >= len(trie.check) or trie.check[to] != state:
                return -1
            state = to
        return trie.value[state]

    for w, k in keys.items():
        assert find(w) == k
    assert find(b"zzz") == -1


def test_documents(spark):
    rows = [(k, t, 1) for k, t in enumerate([*TEXTS, None])] + [(2, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sp.encode_documents(docs, PIECES)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        text = TEXTS[r["doc_id"]] if r["doc_id"] < len(TEXTS) else ""
        want = brute(text)
        assert r["ids"] == want and r["n_ids"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<i4").tobytes())
        assert r["restored"] == ("▁" not in text)
    back = {r["doc_id"]: r["text"] for r in sp.decode_documents(got, PIECES).collect()}
    assert back[3] == TEXTS[3] and back[len(TEXTS)] == ""
    assert sp.encode_documents(docs.limit(0), PIECES).collect() == []
