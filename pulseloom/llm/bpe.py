"""Byte-level BPE ids in Python workers.

``encode`` gives the ids that the ``tokenizers`` library gives for
``byte_bpe_50k.json`` with ``add_special_tokens=False``. Ordinary texts go through
``tiktoken`` with the same vocabulary, which is several times faster; texts that
spell a special token, or hold characters that the two libraries' Unicode tables
may class differently, go through ``tokenizers`` itself.

``encode_all`` and ``count_all`` take a batch of texts and encode each of its distinct
words once: the vocabulary's pattern always cuts before a space that a word follows, so
the ids of `` word`` don't depend on what stands around it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"

#: ASCII, Latin, Greek and Cyrillic letters, general punctuation, kana and the unified
#: ideographs: blocks fully assigned long before either library's Unicode tables.
_SETTLED = re.compile(r"[\x00-ɏΑ-ΡΣ-ώЀ-ҁ -‧‰-⁞ぁ-ゖァ-ヺ一-龥]*\Z")

#: A space that no word follows; texts with one aren't cut into words.
_LOOSE = re.compile(r" (?:\s|\Z)")
#: Bytes of text that are encoded together; more share more words and take more memory.
_TOGETHER = 8 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, vocabulary: str = DEFAULT_VOCABULARY) -> np.ndarray:
    """The ids of one text as uint32."""
    if SPECIAL not in text and _SETTLED.match(text):
        return _fast(vocabulary_path(f"{vocabulary}.tiktoken")).encode_to_numpy(text)
    ids = _exact(vocabulary_path(f"{vocabulary}.json")).encode(text, add_special_tokens=False).ids
    return np.asarray(ids, dtype=np.uint32)


def count(text: str, vocabulary: str = DEFAULT_VOCABULARY) -> int:
    """How many ids ``encode`` gives, without making an array of them."""
    if SPECIAL not in text and _SETTLED.match(text):
        return len(_fast(vocabulary_path(f"{vocabulary}.tiktoken"))._core_bpe.encode_ordinary(text))
    return len(encode(text, vocabulary))


@lru_cache(maxsize=4)
def _begins_word(path: str) -> np.ndarray:
    """Whether an id's bytes begin with a space."""
    begins = np.zeros(_fast(path).max_token_value + 1, bool)
    with open(path, "rb") as lines:
        for token, rank in (line.split() for line in lines if line.strip()):
            begins[int(rank)] = base64.b64decode(token)[:1] == b" "
    return begins


def _words(texts: pa.Array, vocabulary: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of the words one after another, where a word's begin, the words in order of texts, where a text's begin), some texts at a time."""
    path = f"{vocabulary}.tiktoken"
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")))
        part = pc.fill_null(texts[at:to], "")
        whole, at = part.to_pylist(), to
        if len(whole) == 1:  # it shares no words with others
            ids = encode(whole[0], vocabulary)
            yield ids, np.array([0, len(ids)]), np.zeros(1, np.int32), np.array([0, 1])
            continue
        fast = _fast(vocabulary_path(path))._core_bpe
        cut = [SPECIAL not in t and bool(_SETTLED.match(t)) and not _LOOSE.search(t) for t in whole]
        lists = pc.split_pattern(pc.if_else(pa.array(cut), part.cast(pa.string()), ""), " ")
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        spaced = np.ones(first[-1], bool)
        spaced[first[:-1]] = False  # a text's first word has no space before it
        coded = lists.flatten().filter(pa.array(spaced)).dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        ids = np.array(fast.encode_ordinary(f" {joined}"), np.uint32)
        starts = np.flatnonzero(_begins_word(vocabulary_path(path))[ids])
        # first words, and whole texts where they aren't cut, follow the shared ones
        heads = [np.array(fast.encode_ordinary(t.partition(" ")[0]), np.uint32) if c else encode(t, vocabulary) for t, c in zip(whole, cut)]
        index = np.empty(len(spaced), np.int32)
        index[spaced], index[~spaced] = coded.indices.to_numpy(), len(starts) + np.arange(len(heads))
        yield np.concatenate([ids, *heads]), np.concatenate([starts, len(ids) + np.cumsum([0, *map(len, heads)])]), index, first


def encode_all(texts: pa.Array, vocabulary: str = DEFAULT_VOCABULARY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``encode`` gives for each text (null: none), one after another, and how many ids each has; some texts at a time."""
    for ids, starts, index, first in _words(texts, vocabulary):
        sizes = np.diff(starts)[index]
        ends = np.append(0, np.cumsum(sizes))
        at = np.repeat((starts[index] - ends[:-1]).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        yield ids[at], np.diff(ends[first])


def count_all(texts: pa.Array, vocabulary: str = DEFAULT_VOCABULARY) -> Iterator[np.ndarray]:
    """How many ids ``encode_all`` gives for each text, without gathering them."""
    for _, starts, index, first in _words(texts, vocabulary):
        yield np.diff(np.append(0, np.cumsum(np.diff(starts)[index]))[first])
