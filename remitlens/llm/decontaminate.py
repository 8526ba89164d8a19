"""Benchmark decontamination: one Aho-Corasick scan of every text.

Benchmark items become windows of consecutive normalised words. Each distinct word of the
windows is one symbol, every other word one shared symbol, so a text is a symbol string and the
automaton walks it once, whatever the number of windows. Word offsets lead back to the
original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, materialize, slices

WINDOW = 10
#: Words of one automaton. A larger benchmark is worked off in blocks of so many words, each
#: with one scan, so what is sent to the executors has a fixed bound.
BLOCK_WORDS = 500_000

#: Word bytes are digits, lower-case ASCII letters and all of non-ASCII; A-Z fold to a-z.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UNKNOWN = "\x00"

HITS = "spans array<struct<first:int,last:int,start:int,stop:int>>, items array<string>, n_words long"


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


class Matcher:
    """The automaton of one block of benchmark items."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int) -> None:
        import ahocorasick

        letters: dict[bytes, str] = {}
        patterns: dict[str, set[str]] = {}
        for item, text in items:
            found = words(text)
            line = "".join(
                letters.setdefault(w, chr(len(letters) + 1 + 2048 * (len(letters) > 0xD700)))
                for w in found
            )
            size = min(window, len(line))
            for at in range(len(line) - size + 1 if size else 0):
                patterns.setdefault(line[at : at + size], set()).add(item)
        self.letters = _Letters(letters)
        self.automaton = ahocorasick.Automaton()
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(owners)))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges that windows cover, and the items they belong to."""
        if self.empty or not found:
            return [], set()
        line = "".join(map(self.letters.__getitem__, found))
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (size, owners) in self.automaton.iter(line):
            ranges.append((end + 1 - size, end + 1))
            items.update(owners)
        return merged(ranges), items


class _Letters(dict):
    def __missing__(self, word: bytes) -> str:
        return _UNKNOWN


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def char_spans(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges with the character offsets they have in the original text."""
    at = [m.span() for m in _WORD.finditer(raw)]
    chars = lambda b: len(raw[:b].decode("utf-8", "ignore"))
    return [
        {"first": a, "last": b, "start": chars(at[a][0]), "stop": chars(at[b - 1][1])}
        for a, b in ranges
    ]


_matchers: dict[str, Matcher] = {}


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    block: list[tuple[str, str | None]] = []
    total = 0
    rows = benchmark.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string"), "text"
    )
    for item, text in rows.toLocalIterator():
        size = len(words(text))
        if block and total + size > block_words:
            yield block
            block, total = [], 0
        block.append((item, text))
        total += size
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of ``docs`` with ``contamination``: spans, items, n_words.

    ``spans`` are the merged word ranges (first inclusive, last exclusive) inside occurrences of
    any window, with character offsets; ``items`` the item ids having such windows, sorted as
    strings. A null text has no words. Items with a null id or no word are no item; an item
    shorter than the window is one window. An existing column named ``contamination`` is
    replaced. Repeated rows are judged one by one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    name = "contamination"
    keep = [c for c in docs.columns if c != name]
    out = docs.select(*(F.col(f"`{c}`") for c in keep))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema]
    schema = ", ".join([*kinds, f"{name} struct<{HITS.replace(' array', ':array').replace(' long', ':long')}>"])
    blocks = 0
    for block in _blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(block)
        if blocks:
            out = materialize(out, "scanned")
        out = out.mapInArrow(_scanner(sent, window, uuid.uuid4().hex, keep), schema)
        blocks += 1
    if not blocks:
        out = out.mapInArrow(_scanner(None, window, uuid.uuid4().hex, keep), schema)
    return out


def _scanner(sent, window: int, key: str, keep: list[str]):
    name = "contamination"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(sent.value if sent else [], window)
        matcher = _matchers[key]
        for batch in batches:
            before = batch.column(name).to_pylist() if name in batch.schema.names else None
            rows = []
            for lo, hi, data, at in slices(batch):
                raw = data.tobytes()
                for i in range(hi - lo):
                    text = raw[at[i] : at[i + 1]]
                    found = words(text)
                    ranges, items = matcher.scan(found)
                    if before:
                        old = before[lo + i]
                        ranges = merged(ranges + [(s["first"], s["last"]) for s in old["spans"]])
                        items |= set(old["items"])
                    spans = char_spans(text, ranges) if ranges else []
                    rows.append({"spans": spans, "items": sorted(items), "n_words": len(found)})
            span = pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "stop")])
            kind = pa.struct(
                [("spans", pa.list_(span)), ("items", pa.list_(pa.string())), ("n_words", pa.int64())]
            )
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*keep, name])

    return scan


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate(
        "contamination.spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"]
    )
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("contamination.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item."""
    found = find_contamination(docs, benchmark, window)
    return found.where(F.size("contamination.spans") == 0).drop("contamination")
