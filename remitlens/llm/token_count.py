"""Token counts of whole texts by a compiled byte-pair transducer.

A first machine cuts a text into words from character classes, looking one character back and
three ahead; each word starts the second machine afresh, so words are chunks whose
state maps are constant and whose counts a prefix sum composes. Very long words are cut into
chunks whose maps are composed by a scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, slices
from remitlens.llm.transducer import Merges, Transducer

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3


def character_classes() -> bytes:
    """Class of every code point as the library's own patterns see it (1.1 MB, fixed)."""
    from tokenizers import Regex, pre_tokenizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    classes = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
        splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for _, (a, b) in splitter.pre_tokenize_str(text):
            classes[points[a:b]] = kind
    return classes.tobytes()


def word_starts(points: np.ndarray, classes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """True at each code point that starts a word; ``fresh`` marks the starts of texts."""
    n = len(points)
    kind = classes[points]
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # white space before something else: the last of it stands alone, or leads if a blank
    after = np.flatnonzero(start & ~fresh & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # an apostrophe that starts a word takes the endings s t m d re ve ll with it
    mark = np.flatnonzero((points == 39) & start)
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    closed = np.concatenate([fresh, np.ones(3, bool)])
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    pair = one.astype(np.int64) * 256 + np.minimum(two, 255)
    long = np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    long &= ~closed[mark + 2]
    size = np.where(closed[mark + 1], 0, np.where(short, 2, np.where(long, 3, 0)))
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    behind = mark + size
    behind = behind[behind < n]
    start[behind[kind[behind] == LETTER]] = True
    return start


class Counter:
    """A worker's machine for one tokenizer file."""

    def __init__(self, path: str, classes: bytes) -> None:
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        self.special = [t["content"].encode() for t in added]
        self.classes = np.frombuffer(classes, np.uint8)
        self.machine = Transducer(Merges(path))

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        found = []
        if self.special and len(data):
            raw = data.tobytes()
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    inside = np.searchsorted(offsets, at, "right")
                    if inside >= len(offsets) or at + len(s) <= offsets[inside]:
                        found.append((at, at + len(s)))
                        at = raw.find(s, at + len(s))
                    else:
                        at = raw.find(s, at + 1)
        return sorted(found)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; special strings count one and part what is around them."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        cuts = np.zeros(len(data) + 1, bool)
        cuts[offsets] = True
        special = self._specials(data, offsets)
        for a, b in special:
            cuts[a] = cuts[b] = True
        start = word_starts(points, self.classes, cuts[heads])
        begin = heads[start]
        end = np.append(begin[1:], len(data))
        if special:
            firsts = np.array([a for a, _ in special])
            lasts = np.array([b for _, b in special])
            owner = np.searchsorted(firsts, begin, "right") - 1
            plain = (owner < 0) | (begin >= lasts[owner])
            begin, end = begin[plain], end[plain]
        counts = self.machine.counts(data, begin, end)
        running = np.concatenate([[0], np.cumsum(counts)])
        total = np.diff(running[np.searchsorted(begin, offsets, "left")])
        if special:
            np.add.at(total, np.searchsorted(offsets, firsts, "right") - 1, 1)
        return total


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; a null text counts as empty.

    One pass without a shuffle. Repeated rows give repeated rows; a null doc_id stays null.
    """
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(character_classes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = Counter(tokenizer_path, classes.value)
        counter = _counters[tokenizer_path]
        for batch in batches:
            for lo, hi, data, offsets in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(counter.count(data, offsets), pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
