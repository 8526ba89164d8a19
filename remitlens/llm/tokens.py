"""Token ids of whole texts by a tokenizer file, a word at a time with a bounded memo."""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np

#: Words kept in a worker's memo; when it is full it starts anew, results never change.
MEMO_WORDS = 900_000


#: Signs between an ASCII letter or digit and white space are a piece of their own before merging, so
#: they may be cut off; far fewer distinct words are left. The pattern begins with the sign, so that a
#: search goes from sign to sign instead of trying every byte.
_TAIL = re.compile(rb"([!-/:-@\[-`{-~](?<=[A-Za-z0-9].)[!-/:-@\[-`{-~]*+)(?=[\x20\x09-\x0D])")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
#: New words go through the library so many at a time, with this sign between them.
WORDS_A_CALL = 256
_BETWEEN = "\x01"


class _Memo(dict):
    """Word to number; unknown words get the next number and wait in ``new``."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTokenizer:
    """Ids of texts under a tokenizer whose tokens never span ASCII white space.

    Holds for tokenizers that lower-case, drop white space and keep letters, digits and
    signs apart before merging, so that a text's ids are those of its words in turn. Each
    distinct word goes through the library once per memo. Texts that may hold a special
    string are cut at white space only.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        self.path, self.memo_words = path, memo_words
        self._library = None
        self._clear()

    def _clear(self) -> None:
        self._memo = _Memo()
        self._ids = np.zeros(1 << 16, np.uint16)
        self._ends = np.zeros(1 << 16, np.int64)
        self._known = 0

    def _encode_new(self) -> None:
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            if self._library.get_vocab_size() > 1 << 16:
                self._ids = self._ids.astype(np.uint32)
            self._between = self._ids_of([_BETWEEN])[0]
        words, self._memo.new = self._memo.new, []
        decoded = [w.decode("utf-8", "replace") for w in words]
        ids, counts = self._ids_by_word(decoded)
        known, used = self._known, int(self._ends[self._known])
        ends = used + np.cumsum(counts)
        total = int(ends[-1])
        self._ids = _grown(self._ids, total)
        self._ids[used:total] = ids
        self._ends = _grown(self._ends, known + len(counts) + 1)
        self._ends[known + 1 : known + len(counts) + 1] = ends
        self._known += len(counts)

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_by_word(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and how many each has.

        Many words are one text, with a sign between them that is one token and in no word; a
        call and a list for each word would cost more than its ids. Words that hold the sign or may
        hold a special string are texts of their own.
        """
        parts, counts = [], []
        for lo in range(0, len(words), WORDS_A_CALL):
            some = words[lo : lo + WORDS_A_CALL]
            text = f" {_BETWEEN} ".join(some)
            if len(self._between) == 1 and "<|" not in text and text.count(_BETWEEN) == len(some) - 1:
                flat = np.array(self._ids_of([text])[0], np.int64)
                cuts = np.flatnonzero(flat == self._between[0])
                if len(cuts) == len(some) - 1:
                    parts.append(np.delete(flat, cuts))
                    counts.append(np.diff(np.concatenate([[-1], cuts, [len(flat)]])) - 1)
                    continue
            found = self._ids_of(some)
            parts.append(np.fromiter(chain.from_iterable(found), np.int64))
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(parts), np.concatenate(counts)

    def encode(self, texts: list[bytes], end_id: int | None = None) -> list[np.ndarray]:
        """One array of ids per text; ``end_id`` follows each text when given."""
        if self._known > self.memo_words:
            self._clear()
        words = [
            t.split() if b"<|" in t else _TAIL.sub(rb" \1", t.translate(_FOLD)).split()
            for t in texts
        ]
        find = self._memo.__getitem__
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(find, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if self._memo.new:
            self._encode_new()
        begin = self._ends[at]
        counts = self._ends[at + 1] - begin
        stop = np.cumsum(counts)
        flat = self._ids[np.repeat(begin - stop + counts, counts) + np.arange(int(counts.sum()))]
        cuts = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes)])]
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        return [
            np.concatenate([flat[a:b].astype(np.uint32), tail])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's own copy, kept between batches."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def cut_points(length: int, capacity: int) -> range:
    """Starts of the pieces of a sequence: each full but the last."""
    return range(0, max(length, 1), capacity)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
