"""Quality rules with thresholds that follow each language and source.

One pass gives a few integers per text. Base rules are fixed; every other threshold is a fence
around the middle half of the values seen in the same language and source. Values are
counted in a mergeable histogram sketch (exact below 64, then 32 buckets per power of two), so
each task counts what it reads and sketches add up; a hot source costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, materialize, slices

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fences lie this many times the middle half's width outside of it.
SPREAD = 3
#: Per thousand; the least distance of each fence from the middle half, below, above.
#: None: no fence on that side.
MARGINS = {
    "chars_per_word": (2000, 2000),
    "symbols_per_word": (None, 100),
    "dup_lines": (None, 500),
    "repeat_words": (None, 300),
}

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    size = len(numbers)
    pair = ids[:-1] * size + ids[1:]
    if size > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    if not len(same):
        return 0
    twice = np.zeros(n, bool)
    at = np.concatenate([order[same], order[same + 1]])
    for k in range(3):
        twice[at + k] = True
    return int(twice.sum())


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the six counts of every row; a null text has no words."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(batch):
                raw = data.tobytes()
                inside = np.concatenate(
                    [[0], np.cumsum(((data & 0xC0) != 0x80) & ~_SPACE[data])]
                )
                signs = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
                rows = []
                for i in range(hi - lo):
                    text = raw[at[i] : at[i + 1]]
                    words = text.split()
                    lines, copies = line_counts(text)
                    rows.append((len(words), copies, repeated_words(words), lines))
                n_words, dup, again, lines = np.array(rows, np.int64).T
                columns = (n_words, np.diff(inside[at]), np.diff(signs[at]), dup, again, lines)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang", "source")]
                    + [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "lang", "source", *STATS],
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long"),
        "text",
        F.col("lang").cast("string"),
        F.col("source").cast("string"),
    )
    counts = ", ".join(f"{c} long" for c in STATS)
    return rows.mapInArrow(measure, f"doc_id long, lang string, source string, {counts}")


def per_mille(stats: DataFrame) -> dict[str, Column]:
    """The values under adaptive thresholds: whole numbers, so that every engine agrees."""
    pairs = {
        "chars_per_word": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeat_words": ("n_repeat_words", "n_words"),
    }
    return {
        name: F.expr(f"1000 * {top} div greatest({below}, 1)") for name, (top, below) in pairs.items()
    }


def bucket(value: Column) -> Column:
    """Lower edge of the sketch bucket of a whole number: its six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(stats: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n over the texts that pass the base rules."""
    metrics = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("metric"), bucket(value).alias("bucket"))
                for name, value in per_mille(stats).items()
            )
        )
    ).alias("m")
    return (
        stats.where(~F.col("base_failed"))
        .select("lang", "source", metrics)
        .groupBy("lang", "source", "m.metric", "m.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per language and source: low_ and high_ of each metric, null for no fence."""
    group = Window.partitionBy("lang", "source", "metric")
    placed = counts.select(
        "*",
        F.sum("n").over(group.orderBy("bucket")).alias("_upto"),
        F.sum("n").over(group).alias("_all"),
    )
    reached = lambda k: F.min(F.when(F.expr(f"4 * _upto >= {k} * _all"), F.col("bucket")))
    quartiles = placed.groupBy("lang", "source", "metric").agg(
        reached(1).alias("q1"), reached(3).alias("q3")
    )
    sides = []
    for name, (below, above) in MARGINS.items():
        for side, quart, margin, sign in (("low", "q1", below, -1), ("high", "q3", above, 1)):
            if margin is not None:
                fence = F.expr(f"{quart} + {sign} * greatest({SPREAD} * (q3 - q1), {margin})")
                sides.append(F.max(F.when(F.col("metric") == name, fence)).alias(f"{side}_{name}"))
    return quartiles.groupBy("lang", "source").agg(*sides)


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of every row of ``docs``.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows.
    kept: not base_failed and within every fence of its language and source; null languages
    and sources are groups of their own. An empty table gives no rows.
    """
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    stats = materialize(text_stats(docs).withColumn("base_failed", base), "text_stats")
    limits = thresholds(sketch(stats)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = stats.join(
        limits,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    inside = []
    for name, value in per_mille(stats).items():
        below, above = MARGINS[name]
        if below is not None:
            inside.append(value >= F.col(f"low_{name}"))
        if above is not None:
            inside.append(value <= F.col(f"high_{name}"))
    verdict = F.coalesce(reduce(Column.__and__, inside), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & verdict).drop("_lang", "_source")
