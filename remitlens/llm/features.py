"""Hashed words of whole texts as arrays, for the models that score them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from remitlens.llm.common import rolling_hash, word_spans

#: Letters, digits and all of non-ASCII make words; A-Z fold to a-z.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of a word that stand for its families, from wide to narrow.
STEM_BYTES = (4, 5, 6, 7, 8)


@dataclass
class Words:
    """Words of a slice: where they are, whose they are, their hashes and, if asked for,
    those of their families."""

    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    word: np.ndarray
    stems: list[np.ndarray]


def hashed_words(data: np.ndarray, offsets: np.ndarray, stems: bool = False) -> Words:
    begin, end, row = word_spans(data, offsets, WORD_BYTES)
    folded = _FOLD[data]
    word = rolling_hash(folded, begin, end)
    families = [
        rolling_hash(folded, begin, np.minimum(begin + size, end)) for size in STEM_BYTES * stems
    ]
    return Words(begin, end, row, word, families)


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def per_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)
