"""Ids of the tokenizers library for whole texts, by way of distinct pre-tokens.

The library splits a text into pre-tokens and encodes each by itself, so each
distinct pre-token needs to be encoded once per worker.  ``byte_ids`` is for
byte-level vocabularies without normaliser, ``word_ids`` for word_bpe_49k.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from phaseloom.llm.pretokens import WORDS_PATTERN, PretokenEncoder, runs

SPAN = 4000  # pre-tokens handed to the library as one text


def _load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads cost memory
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _ids_of(t: Tokenizer, text: str) -> np.ndarray:
    """Ids alone: the fast call keeps no offsets."""
    return np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def _counts(ends: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(ends)
    return np.diff(np.concatenate(([-1], at)))


@functools.cache
def _byte_encoder(path: str) -> PretokenEncoder:
    t = _load(path)
    (newline,) = _ids_of(t, "\n")

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.decode("utf-8", "surrogatepass") for p in parts]
        plain = [i for i, w in enumerate(words) if not w.isspace() and "\n" not in w]
        single = [i for i, w in enumerate(words) if w.isspace() or "\n" in w]
        order, flat, sizes = [], [], []
        for k in range(0, len(plain), SPAN):  # a line each: nothing joins across a line's end
            chosen = plain[k : k + SPAN]
            ids = _ids_of(t, "".join([words[i] + "\n" for i in chosen]))
            ends = ids == newline
            counts = _counts(ends) - 1
            if len(counts) != len(chosen) or not ends[-1]:  # not expected: one by one then
                single += chosen
                continue
            order += chosen
            flat.append(ids[~ends])
            sizes.append(counts)
        for i in single:
            flat.append(_ids_of(t, words[i]))
            sizes.append(np.array([len(flat[-1])], np.int64))
        ids, counts = np.concatenate(flat), np.concatenate(sizes)
        if not single:
            return ids, counts
        back = np.argsort(np.array(order + single))  # to the order of parts
        return ids[runs((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    return PretokenEncoder("spaced", public_tokenizers.PATTERN, encode)


@functools.cache
def _word_encoder(path: str) -> tuple[Tokenizer, PretokenEncoder]:
    t = _load(path)
    closes = np.zeros(t.get_vocab_size() + 1, bool)
    for token, i in t.get_vocab().items():
        closes[i] = token.endswith("</w>")

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [p.decode("utf-8", "surrogatepass") for p in parts]
        ids_all, counts_all = [], []
        for k in range(0, len(words), SPAN):
            chosen = words[k : k + SPAN]
            ids = _ids_of(t, " ".join(chosen))
            counts = _counts(closes[ids])
            if len(counts) != len(chosen) or counts.sum() != len(ids):  # not expected: one by one then
                each = [_ids_of(t, w) for w in chosen]
                ids, counts = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            ids_all.append(ids)
            counts_all.append(counts)
        return np.concatenate(ids_all), np.concatenate(counts_all)

    return t, PretokenEncoder("words", WORDS_PATTERN, encode)


def vocabulary_size(path: str) -> int:
    """One more than the greatest id, added tokens included."""
    return 1 + max(_load(path).get_vocab(with_added_tokens=True).values())


def byte_ids(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    for _, ids in _byte_encoder(path).batch(texts):
        yield ids


def word_ids(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """Lower case is taken per character, as the library does; texts in which
    Python's rule depends on the context (capital sigma) go to the library."""
    t, encoder = _word_encoder(path)
    odd = {i for i, x in enumerate(texts) if "Σ" in x}
    ready = ["" if i in odd else x.lower() if x.isascii() else unicodedata.normalize("NFC", x).lower() for i, x in enumerate(texts)]
    for i, ids in encoder.batch(ready):
        yield _ids_of(t, texts[i]) if i in odd else ids
