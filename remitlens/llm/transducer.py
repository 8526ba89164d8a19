"""Byte-pair encoding as a deterministic finite-state transducer over bytes.

A token sequence is what the merges produce exactly when every two neighbours are: merging
the bytes of the two gives the two back. So after each byte there is one token that ends the
encoding of what was read, and reading on needs only those earlier places from which a token
may still grow. A state is that list: for each such place the vocabulary-trie node reached
since, the token ending there, and how many tokens fewer it counts than the current place.
A transition reads one byte, leads to one state, and carries the change of the token count.

Transitions are compiled when first taken and then live in flat arrays, so that thousands of
words walk the machine at once, one byte a step.
"""

from __future__ import annotations

import json
from array import array

import numpy as np

def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: char to byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.bytes_of: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) for token, i in vocab.items()
        }
        self.single = [0] * 256
        for i, raw in self.bytes_of.items():
            if len(raw) == 1:
                self.single[raw[0]] = i
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[a], vocab[b]] = (n, vocab[a + b])

    def encode(self, raw: bytes) -> list[int]:
        """Ids of one word: the lowest-ranked pair merges first, the leftmost among equals."""
        ids = [self.single[b] for b in raw]
        rank = self.rank
        while len(ids) > 1:
            found = [rank.get(p) for p in zip(ids, ids[1:], strict=False)]
            best = min((f for f in found if f), default=None)
            if best is None:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
        return ids


#: Transitions sit in an open-addressing table: key, next state, count change. It is cleared when
#: full, the states in use carried over, and grows only for more spans at a time than it holds.
TABLE_BITS = 21
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Spans longer than this are read as chunks whose state maps are composed.
CHUNK_BYTES = 512


StateMap = dict[bytes, tuple[bytes, int]]


def composed(one: StateMap, two: StateMap) -> StateMap:
    """The map of reading two chunks, from the states the first is known for."""
    return {s: (two[e][0], n + two[e][1]) for s, (e, n) in one.items() if e in two}


class Transducer:
    """States, transitions and count changes, grown as bytes demand them."""

    def __init__(self, merges: Merges, table_bits: int = TABLE_BITS) -> None:
        self.merges, self.bits = merges, table_bits
        self._children: list[dict[int, int] | None] = [{}]
        self._token_at: list[int] = [-1]
        for i, raw in merges.bytes_of.items():
            if merges.encode(raw) != [i]:
                continue  # no text yields this token
            node = 0
            for b in raw:
                if self._children[node] is None:
                    self._children[node] = {}
                step = self._children[node].get(b)
                if step is None:
                    step = len(self._children)
                    self._children[node][b] = step
                    self._children.append(None)
                    self._token_at.append(-1)
                node = step
            self._token_at[node] = i
        self._fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the start; what is needed again is compiled again."""
        first = array("i", (0, -1, 0)).tobytes()
        self._states: list[bytes] = [first]
        self._number: dict[bytes, int] = {first: 0}
        self._keys = np.full(1 << self.bits, -1, np.int64)
        self._next = np.zeros(1 << self.bits, np.int32)
        self._change = np.zeros(1 << self.bits, np.int16)
        self.transitions = 0

    @property
    def crowded(self) -> bool:
        return self.transitions > (1 << self.bits) // 2

    def _neighbours(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        pair = left << 20 | right
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            of = self.merges.bytes_of
            known = self._fits[pair] = self.merges.encode(of[left] + of[right]) == [left, right]
        return known

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the empty place where it belongs."""
        mask = np.int64((1 << self.bits) - 1)
        shift = np.uint64(64 - self.bits)
        slot = ((keys.astype(np.uint64) * _HASH) >> shift).astype(np.int64)
        held = self._keys[slot]
        off = np.flatnonzero((held != keys) & (held >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            held = self._keys[slot[off]]
            off = off[(held != keys[off]) & (held >= 0)]
        return slot

    def _compile(self, key: int) -> None:
        state, byte = key >> 8, key & 255
        fields = array("i")
        fields.frombytes(self._states[state])
        grown, last, change = array("i"), None, 0
        for at in range(0, len(fields), 3):
            node, token, behind = fields[at : at + 3]
            below = self._children[node]
            child = below.get(byte) if below else None
            if child is None:
                continue
            right = self._token_at[child]
            if last is None and right >= 0 and self._neighbours(token, right):
                last, change = right, 1 - behind
            if self._children[child]:
                grown.extend((child, token, behind))
        if last is None:
            raise ValueError("the vocabulary does not cover every byte")
        for at in range(2, len(grown), 3):  # tokens here less those at the earlier place
            grown[at] += change
        grown.extend((0, last, 0))
        name = grown.tobytes()
        slot = int(self._slots(np.array([key]))[0])
        self._keys[slot], self._next[slot], self._change[slot] = key, self._intern(name), change
        self.transitions += 1

    def _intern(self, name: bytes) -> int:
        number = self._number.setdefault(name, len(self._states))
        if number == len(self._states):
            self._states.append(name)
        return number

    def _renewed(self, now: np.ndarray, room: int) -> np.ndarray:
        """Clear the table but for the given states, which get new numbers; it then has the room."""
        live, place = np.unique(now, return_inverse=True)
        names = [self._states[s] for s in live.tolist()]
        while 2 * room > 1 << self.bits:
            self.bits += 1
        self.clear()
        return np.array([self._intern(name) for name in names], np.int32)[place]

    def walk(
        self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """End state and count change of every span, each from its own start state."""
        order = np.argsort(begin - end, kind="stable")  # the longest in front stay to the last
        at, sizes = begin[order], (end - begin)[order]
        now, total = state[order].astype(np.int32), np.zeros(len(begin), np.int64)
        shrink = -sizes
        alive = len(begin)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            alive = int(np.searchsorted(shrink[:alive], -k, "left"))
            read = data[at[:alive] + k]
            keys = now[:alive].astype(np.int64) << 8 | read
            slot = self._slots(keys)
            new = np.unique(keys[self._keys[slot] < 0])
            if len(new):
                if self.transitions + len(new) > (1 << self.bits) * 3 // 4:
                    now = self._renewed(now, alive)
                    keys = now[:alive].astype(np.int64) << 8 | read
                    new = np.unique(keys)
                for key in new.tolist():
                    self._compile(key)
                slot = self._slots(keys)
            now[:alive] = self._next[slot]
            total[:alive] += self._change[slot]
        ends, counts = np.empty_like(now), np.empty_like(total)
        ends[order], counts[order] = now, total
        return ends, counts

    def _maps(
        self, data: np.ndarray, first: np.ndarray, last: np.ndarray, names: list[bytes]
    ) -> list[tuple[bytes, int]]:
        """Where every chunk leads from its state, and the change of the count."""
        start = np.array([self._intern(name) for name in names], np.int32)
        ends, counts = self.walk(data, first, last, start)
        return [(self._states[e], n) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def long_count(self, data: np.ndarray, begin: int, end: int) -> int:
        """Count of one long span by composing the state maps of its chunks.

        All chunks are read at once, each from the state that the bytes before it lead to from
        the start. A parallel prefix scan composes the maps. Where a chunk may end in a state
        that the map of the next one lacks, that entry is read in a further round, all of
        them at once; the machine forgets its past within a few bytes, so the rounds are few.
        States go by their names here, since the table may be cleared in between.
        """
        first = np.arange(begin, end, CHUNK_BYTES)
        last = np.minimum(first + CHUNK_BYTES, end)
        origin = self._states[0]
        before = self._maps(data, np.maximum(first - 64, begin), first, [origin] * len(first))
        wanted = [(c, name) for c, (name, _) in enumerate(before)]
        maps: list[StateMap] = [{} for _ in first]
        while wanted:
            chunks = np.array([c for c, _ in wanted])
            found = self._maps(data, first[chunks], last[chunks], [name for _, name in wanted])
            for (c, name), led in zip(wanted, found, strict=True):
                maps[c][name] = led
            wanted = [
                (c + 1, name)
                for c in range(len(maps) - 1)
                for name in {name for name, _ in maps[c].values()}
                if name not in maps[c + 1]
            ]
        prefix, step = maps, 1
        while step < len(prefix):
            prefix = [
                m if c < step else composed(prefix[c - step], m) for c, m in enumerate(prefix)
            ]
            step *= 2
        return prefix[-1][origin][1]

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Token count of every span of the bytes read from the start state."""
        if self.crowded:
            self.clear()
        long = np.flatnonzero(end - begin > 4 * CHUNK_BYTES)
        total = np.zeros(len(begin), np.int64)
        short = np.flatnonzero(end - begin <= 4 * CHUNK_BYTES)
        zero = np.zeros(len(short), np.int32)
        total[short] = self.walk(data, begin[short], end[short], zero)[1]
        for i in long.tolist():
            if self.crowded:
                self.clear()
            total[i] = self.long_count(data, int(begin[i]), int(end[i]))
        return total
