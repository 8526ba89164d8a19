"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

Every word and every word family (its first bytes) carries the log-odds of toxic against clean
training texts, counted by texts and smoothed by a Dirichlet prior centred on its share of the
corpus. A word takes the log-odds of itself or of that family which tells the classes apart
most surely, or zero if none does beyond chance, and each word pays a small toll. One linear scan finds all maximal-scoring segments of a text. Under the clean
background the best segment of n words exceeds S with E = K n exp(-lambda S) expected cases.
Every occurrence of a word scores in the scan for passages. The probability of a text comes from
the summed evidence of a second scan, in which a word counts only where it first stands in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, materialize, sampled_labels, slices
from remitlens.llm.features import STEM_BYTES, Words, buckets, hashed_words, per_row

#: Labelled rows that the fit reads at most (about; chosen by hash).
MAX_LABELLED = 50_000
#: Texts of the Dirichlet prior.
PRIOR_TEXTS = 10.0
#: Log-odds nearer to zero than this do not count.
MIN_ODDS = 3.5
TOLL = 0.2
MAX_SCORE = 8.0
#: Evidence beyond this adds nothing; keeps the logistic map finite.
MAX_EVIDENCE = 60.0

SEGMENTS = "array<struct<first:int,last:int,start:int,stop:int,score:double>>"


#: Bits of the table that sorts out, before the exact look-up, hashes that carry no score.
SIEVE_BITS = 20


@dataclass(frozen=True)
class Lexicon:
    """Scores of the 64-bit hashes that tell the classes apart, sorted by hash."""

    key: np.ndarray
    score: np.ndarray
    z: np.ndarray
    rate: float  # lambda of the background

    def values(self, words: Words) -> np.ndarray:
        """Score of each word: that of its surest slot, less the toll."""
        best, sure = np.zeros(len(words.row)), np.zeros(len(words.row))
        if len(self.key):
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[buckets(self.key, SIEVE_BITS)] = True
            for slot in slots(words):
                maybe = np.flatnonzero(sieve[buckets(slot, SIEVE_BITS)])
                at = np.minimum(np.searchsorted(self.key, slot[maybe]), len(self.key) - 1)
                found = self.key[at] == slot[maybe]
                maybe, at = maybe[found], at[found]
                better = np.abs(self.z[at]) > sure[maybe]
                maybe, at = maybe[better], at[better]
                best[maybe], sure[maybe] = self.score[at], np.abs(self.z[at])
        return best - TOLL


def slots(words: Words) -> list[np.ndarray]:
    """The word's hash, then that of each of its families, told apart by kind."""
    kinds = [words.word, *words.stems]
    return [h * np.uint64(2 * k + 1) for k, h in enumerate(kinds)]


def count_slots(docs: DataFrame) -> DataFrame:
    """slot, whole, toxic, clean: texts of each label that hold the word (whole) or family.

    The row of slot null counts all texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch):
                toxic = labels[lo:hi] == 1
                words = hashed_words(data, offsets, stems=True)
                n = np.array([toxic.sum(), len(toxic) - toxic.sum()])
                yield _counts(pa.nulls(1, pa.int64()), True, n[:1], n[1:])
                for kind, slot in enumerate(slots(words)):
                    # one entry per text and slot, then counts per slot of this slice
                    order = np.lexsort((words.row, slot))
                    h, row = slot[order], words.row[order]
                    if not len(h):
                        continue
                    fresh = np.ones(len(h), bool)
                    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    h, bad = h[fresh], toxic[row[fresh]]
                    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    of_all = np.diff(np.append(first, len(h)))
                    of_bad = np.add.reduceat(bad.astype(np.int64), first)
                    keys = pa.array(h[first].view(np.int64))
                    yield _counts(keys, kind == 0, of_bad, of_all - of_bad)

    counted = docs.select("text", "label").mapInArrow(
        count, "slot long, whole boolean, toxic long, clean long"
    )
    return counted.groupBy("slot", "whole").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _counts(slot: pa.Array, whole: bool, toxic: np.ndarray, clean: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [slot, pa.array(np.full(len(slot), whole)), pa.array(toxic), pa.array(clean)],
        ["slot", "whole", "toxic", "clean"],
    )


def background_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The lambda above 0 at which the clean words' mean of exp(lambda score) is 1."""
    total = weights.sum()
    if not total or not (scores[weights > 0] > 0).any():
        return 1.0
    low, high = 1e-3, 5.0
    for _ in range(60):
        middle = (low + high) / 2
        if (weights * np.exp(np.minimum(middle * scores, 700))).sum() > total:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def fit_lexicon(counts: DataFrame) -> Lexicon:
    """Scores from the slot counts. Only slots that tell the classes apart come to the driver:
    each takes several toxic texts of the bounded sample, so they are bounded with it.
    """
    nothing = np.zeros(0)
    totals = counts.agg(
        F.sum(F.when(F.col("slot").isNull(), F.col("toxic"))).alias("toxic"),
        F.sum(F.when(F.col("slot").isNull(), F.col("clean"))).alias("clean"),
        F.count("slot").alias("slots"),
        F.sum(F.when(F.col("slot").isNotNull() & F.col("whole"), F.col("clean"))).alias("words"),
    ).first()
    if not totals["toxic"] or not totals["clean"]:
        return Lexicon(nothing.astype(np.uint64), nothing, nothing, 1.0)
    toxic, clean = F.col("toxic"), F.col("clean")
    share = (toxic + clean) / float(totals["toxic"] + totals["clean"])
    prior = share * PRIOR_TEXTS
    odds = F.log((toxic + prior) / (totals["toxic"] + PRIOR_TEXTS)) - F.log(
        (clean + prior) / (totals["clean"] + PRIOR_TEXTS)
    )
    part = lambda n, total: F.when(n > 0, n * F.log(n / (share * float(total)))).otherwise(0.0)
    ratio = 2 * (part(toxic, totals["toxic"]) + part(clean, totals["clean"]))
    # chance alone would bring the surest of so many slots about this far
    chance = float(np.sqrt(2 * np.log(max(totals["slots"], 2))))
    found = (
        counts.where(F.col("slot").isNotNull())
        .select("slot", "whole", "clean", odds.alias("odds"), F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("z"))
        .where((F.col("z") >= chance) & (F.abs("odds") >= MIN_ODDS))
        .toPandas()
    )
    key = found["slot"].to_numpy(np.int64).view(np.uint64)
    score = np.clip(found["odds"].to_numpy(float), -MAX_SCORE, MAX_SCORE)
    order = np.argsort(key)
    whole = found["whole"].to_numpy(bool)
    weight = found["clean"].to_numpy(float)[whole]
    rest = max(float(totals["words"]) - weight.sum(), 0.0)
    rate = background_rate(np.append(score[whole], 0.0) - TOLL, np.append(weight, rest))
    return Lexicon(key[order], score[order], found["z"].to_numpy(float)[order], rate)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score), found in linear time.

    Candidates are kept with the totals before and after them; a new one joins the nearest
    earlier candidate that starts lower, if it also ends higher than that one.
    """
    kept: list[list[float]] = []  # first, last, total before, total after
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= new[2]:
                at -= 1
            if at < 0 or kept[at][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[at][0], new[1], kept[at][2], new[3]]
            del kept[at:]
    return [(int(a), int(b), after - before) for a, b, before, after in kept]


def score_segments(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_words and ``segments`` of every row: word ranges, character offsets, scores.

    ``fresh`` has the scores of the segments when words count only where they first stand.
    The scan runs over the words that score above zero and the summed tolls between them.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Lexicon = sent.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch):
                found = hashed_words(data, offsets, stems=True)
                value = model.values(found)
                n = hi - lo
                first = np.searchsorted(found.row, np.arange(n + 1), "left")
                good = np.flatnonzero(value > 0)
                # repeats score in the scan; for the text as a whole they only pay the toll
                order = good[np.lexsort((good, found.word[good], found.row[good]))]
                again = np.zeros(len(order), bool)
                again[1:] = (found.word[order][1:] == found.word[order][:-1]) & (
                    found.row[order][1:] == found.row[order][:-1]
                )
                damped = value.copy()
                damped[order[again]] = -TOLL
                fresh: list[list[float]] = [[] for _ in range(n)]
                for row, _, line in _lines(damped, np.sort(order[~again]), found.row):
                    fresh[row] = [s for _, _, s in maximal_segments(line)]
                segments: list[list[dict]] = [[] for _ in range(n)]
                for row, at, line in _lines(value, good, found.row):
                    base = offsets[row]
                    for a, b, s in maximal_segments(line):
                        head, tail = int(at[a // 2]), int(at[(b - 1) // 2])
                        segments[row].append(
                            {
                                "first": head - int(first[row]),
                                "last": tail + 1 - int(first[row]),
                                "start": _chars(data[base : found.begin[head]]),
                                "stop": _chars(data[base : found.end[tail]]),
                                "score": s,
                            }
                        )
                counts = per_row(found.row, np.ones(len(found.row)), n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        pa.array(counts),
                        pa.array(segments, _SEGMENT_TYPE),
                        pa.array(fresh, pa.list_(pa.float64())),
                    ],
                    ["doc_id", "n_words", "segments", "fresh"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(score, f"doc_id long, n_words long, segments {SEGMENTS}, fresh array<double>")


_SEGMENT_TYPE = pa.list_(
    pa.struct(
        [(c, pa.int32()) for c in ("first", "last", "start", "stop")] + [("score", pa.float64())]
    )
)


def _lines(
    value: np.ndarray, good: np.ndarray, row: np.ndarray
) -> Iterator[tuple[int, np.ndarray, list[float]]]:
    """Of each row with good words: their places, and their values with the sums between them."""
    running = np.concatenate([[0.0], np.cumsum(value)])
    owner = row[good]
    for r in np.unique(owner).tolist():
        at = good[np.searchsorted(owner, r) : np.searchsorted(owner, r, "right")]
        line = np.empty(2 * len(at) - 1)
        line[0::2] = value[at]
        line[1::2] = running[at[1:]] - running[at[:-1] + 1]
        yield r, at, line.tolist()


def _chars(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def fit_logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and intercept of label on x by damped Newton steps."""
    ones, total = float((weight * label).sum()), float(weight.sum())
    if not total or ones in (0.0, total):
        return 0.0, 0.0 if not total else (4.0 if ones else -4.0)
    slope, level = 0.0, float(np.log(ones / (total - ones)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + level, -30, 30)))
        v = weight * p * (1 - p)
        g = weight * (label - p)
        a, b, c = (v * x * x).sum() + 1e-3, (v * x).sum(), v.sum() + 1e-6
        d, e = (g * x).sum() - 1e-3 * slope, g.sum()
        det = a * c - b * b
        up, shift = (c * d - b * e) / det, (a * e - b * d) / det
        slope, level = slope + np.clip(up, -1, 1), level + np.clip(shift, -1, 1)
        if abs(up) + abs(shift) < 1e-8:
            break
    return max(float(slope), 0.0), float(level)


def evidence(rate: float, k: float) -> Column:
    """Sum over segments of lambda S - ln(K n) where it is positive, S without repeated words."""
    floor = F.log(F.lit(k) * F.greatest("n_words", F.lit(1)))
    summed = F.aggregate(
        "fresh",
        F.lit(0.0),
        lambda s, x: s + F.greatest(F.lit(0.0), F.lit(rate) * x - floor),
    )
    return F.least(summed, F.lit(MAX_EVIDENCE))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_words, segments, evidence, score, predicted of every row of ``docs``.

    ``segments`` lists the significant passages (E-value below 1) with character offsets. The
    score is the calibrated probability of label 1; texts without words, null ones included,
    get the score of no evidence. Without training labels every score is 0.5, with a single
    class the score is near that class. Repeated rows are scored alike.
    """
    bounded_batches(docs.sparkSession)
    known = sampled_labels(labels, "toxic", max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(count_slots(rows.join(known, "doc_id")), "slot_counts")
    lexicon = fit_lexicon(counts)
    scored = materialize(score_segments(rows, lexicon), "segments")
    trained = scored.join(known, "doc_id")
    clean = trained.where("label = 0 and n_words > 0")

    def expected(scores: Column) -> Column:
        top = F.coalesce(F.array_max(scores), F.lit(0.0))
        return F.avg(F.col("n_words") * F.exp(-lexicon.rate * top))

    means = clean.agg(
        expected(F.transform("segments", lambda s: s["score"])), expected(F.col("fresh"))
    ).first()
    k_scan, k = (1 / mean if mean else 1.0 for mean in means)
    strength = evidence(lexicon.rate, k)
    # whole tenths of the evidence: at most 601 rows per label
    steps = (
        trained.groupBy(F.round(strength * 10).alias("x"), "label").agg(F.count("*").alias("n"))
    ).toPandas()
    slope, level = fit_logistic(
        steps["x"].to_numpy(float) / 10, steps["label"].to_numpy(float), steps["n"].to_numpy(float)
    )
    probability = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(level))))
    floor = F.log(F.lit(k_scan) * F.greatest("n_words", F.lit(1)))
    significant = F.filter("segments", lambda s: F.lit(lexicon.rate) * s["score"] > floor)
    return scored.select(
        "doc_id", "n_words", significant.alias("segments"), strength.alias("evidence")
    ).withColumns({"score": probability, "predicted": (probability >= 0.5).cast("int")})


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
