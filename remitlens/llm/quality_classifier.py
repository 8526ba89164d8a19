"""Quality classifier: a factorisation machine over hashed words, structure and size.

A text is a sparse vector: its hashed words (log counts, scaled to length one) and a
few structure statistics. The score is the logistic of a linear part plus all pairwise
interactions under low-rank factors, summed in linear time: half of the squared sum less the
sum of squares, per factor. Labels, language, source and ids are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, materialize, slices, tasks_for, train_labels
from remitlens.llm.features import buckets, hashed_words, per_row

#: Labelled rows of one fit (about; dealt by hash). More are fitted side by side and averaged.
SHARD_LABELLED = 16_000
#: Hashed words; the model has (2^15 + statistics) x (1 + RANK) numbers whatever the corpus.
WORD_BITS = 15
RANK = 8
EPOCHS = 12
BATCH = 256
STEP = 0.05
DECAY = 1e-4
PASS_AT = 0.3

STATS = [
    "words", "length", "upper", "digits", "signs", "bars", "marks", "stops", "lines",
    "high", "distinct", "top", "word_length", "odd_lines",
]


def _share(member: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in member]] = True
    return out


_CLASSES = {
    "upper": _share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _share("0123456789"),
    "signs": _share("#*$%&<>@^~"),
    "bars": _share("|\\/_="),
    "marks": _share("!?"),
    "stops": _share(".,;:"),
    "lines": _share("\n"),
}
_HIGH = np.arange(256) >= 128


@dataclass
class Features:
    row: np.ndarray  # of each sparse entry, ascending
    slot: np.ndarray
    value: np.ndarray
    stats: np.ndarray  # rows x STATS


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    n = len(offsets) - 1
    found = hashed_words(data, offsets)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    keys, counts = np.unique(
        found.row * (1 << WORD_BITS) + buckets(found.word, WORD_BITS), return_counts=True
    )
    row, slot = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    value = np.log1p(counts)
    norm = np.sqrt(per_row(row, value * value, n))
    value = value / np.maximum(norm[row], 1e-9)
    n_words = per_row(found.row, np.ones(len(found.row)), n)
    some = np.maximum(n_words, 1)
    top = np.zeros(n)
    np.maximum.at(top, row, counts)
    stats = {"words": np.log1p(n_words) / 5, "length": np.log1p(np.diff(offsets)) / 8}
    for name, members in _CLASSES.items():
        running = np.concatenate([[0], np.cumsum(members[data])])
        stats[name] = np.diff(running[offsets]) / (some if name in ("signs", "bars", "marks", "stops") else size)
    running = np.concatenate([[0], np.cumsum(_HIGH[data])])
    stats["high"] = np.diff(running[offsets]) / size
    stats["distinct"] = np.bincount(row, minlength=n) / some
    stats["top"] = top / some
    stats["word_length"] = per_row(found.row, (found.end - found.begin).astype(float), n) / some / 8
    stats["odd_lines"] = repeated_lines(data, offsets) / np.maximum(stats["lines"] * size + 1, 1)
    return Features(row, slot, value, np.stack([np.clip(stats[s], 0, 4) for s in STATS], axis=1))


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text beyond the distinct ones, by their hashes."""
    from remitlens.llm.common import rolling_hash, word_spans

    begin, end, row = word_spans(data, offsets, ~_CLASSES["lines"])
    n = len(offsets) - 1
    hashed = rolling_hash(data, begin, end)
    order = np.lexsort((hashed, row))
    same = (hashed[order][1:] == hashed[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=n).astype(float)


@dataclass
class Machine:
    """Weights of a factorisation machine; statistics are slots after the words."""

    level: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, f: Features) -> np.ndarray:
        n = len(f.stats)
        words = 1 << WORD_BITS
        dense = np.clip((f.stats - self.mean) / self.scale, -4, 4)
        linear = self.level + per_row(f.row, self.weight[f.slot] * f.value, n)
        linear += dense @ self.weight[words:]
        pairs = np.zeros(n)
        for k in range(self.factor.shape[1]):
            x = self.factor[f.slot, k] * f.value
            y = dense * self.factor[words:, k]
            summed = per_row(f.row, x, n) + y.sum(axis=1)
            squares = per_row(f.row, x * x, n) + (y * y).sum(axis=1)
            pairs += 0.5 * (summed * summed - squares)
        return 1 / (1 + np.exp(-np.clip(linear + pairs, -30, 30)))


def fit_machine(stats, starts, slots, values, labels, seed: int = 7, mean=None, scale=None) -> Machine:
    """Adam on the log loss over bounded rows held as flat arrays.

    ``mean`` and ``scale`` of the statistics are those of the rows unless given.
    """
    rng = np.random.default_rng(seed)
    words, n, d = 1 << WORD_BITS, len(labels), len(STATS)
    if mean is None:
        mean = stats.mean(axis=0) if n else np.zeros(d)
        scale = np.maximum(stats.std(axis=0), 1e-3) if n else np.ones(d)
    rate = float(labels.mean()) if n else 0.5
    level = float(np.log(np.clip(rate, 0.02, 0.98) / (1 - np.clip(rate, 0.02, 0.98))))
    theta = np.zeros((words + d, 1 + RANK))
    if n and 0 < rate < 1:
        theta[:, 1:] = rng.normal(0, 0.02, (words + d, RANK))
        dense_all = np.clip((stats - mean) / scale, -4, 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        m0 = v0 = 0.0
        step = 0
        for _ in range(EPOCHS):
            shuffled = rng.permutation(n)
            for at in range(0, n, BATCH):
                rows = shuffled[at : at + BATCH]
                size = len(rows)
                counts = starts[rows + 1] - starts[rows]
                stop = np.cumsum(counts)
                flat = np.repeat(starts[rows] - stop + counts, counts) + np.arange(int(counts.sum()))
                owner = np.repeat(np.arange(size), counts)
                slot, value = slots[flat], values[flat][:, None]
                dense = dense_all[rows]
                entry = theta[slot]
                x, y = entry * value, dense[:, :, None] * theta[None, words:]
                summed = np.zeros((size, 1 + RANK))
                np.add.at(summed, owner, x)
                summed += y.sum(axis=1)
                squares = np.zeros((size, RANK))
                np.add.at(squares, owner, x[:, 1:] ** 2)
                squares += (y[:, :, 1:] ** 2).sum(axis=1)
                inner = summed[:, 1:]
                raw = level + summed[:, 0] + 0.5 * (inner * inner - squares).sum(axis=1)
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]
                used, back = np.unique(slot, return_inverse=True)
                grad = np.zeros((len(used) + d, 1 + RANK))
                e = error[owner][:, None]
                local = np.concatenate(
                    [e * value, e * value * (inner[owner] - x[:, 1:])], axis=1
                )
                np.add.at(grad, back, local)
                grad[len(used) :, 0] = error @ dense
                grad[len(used) :, 1:] = np.einsum(
                    "i,ij,ijk->jk", error, dense, inner[:, None, :] - y[:, :, 1:]
                )
                at_slots = np.concatenate([used, np.arange(words, words + d)])
                grad = grad / size + DECAY * theta[at_slots]
                step += 1
                m[at_slots] = 0.9 * m[at_slots] + 0.1 * grad
                v[at_slots] = 0.99 * v[at_slots] + 0.01 * grad * grad
                theta[at_slots] -= STEP * m[at_slots] / (np.sqrt(v[at_slots]) + 1e-6)
                m0, v0 = 0.9 * m0 + 0.1 * error.mean(), 0.99 * v0 + 0.01 * error.mean() ** 2
                level -= STEP * m0 / (np.sqrt(v0) + 1e-6)
    return Machine(level, theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def _fitted(found: pa.Table, mean=None, scale=None) -> Machine:
    """The machine of the rows of a table (label, slots, values, stats)."""
    column = lambda c: found.column(c).combine_chunks()
    lists = column("slots")
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return fit_machine(
        column("stats").flatten().to_numpy().reshape(-1, len(STATS)),
        starts,
        lists.flatten().to_numpy(),
        column("values").flatten().to_numpy().astype(np.float64),
        column("label").to_numpy().astype(np.float64),
        mean=mean,
        scale=scale,
    )


def _averaged(rows: DataFrame) -> Machine:
    """The mean of the machines of all shards of a table (shard, doc_id, label, slots, values, stats).

    Each shard is fitted by one task, from the same first weights; statistics are scaled by the
    mean and deviation of all rows, and a shard counts by its rows.
    """
    spread = (
        rows.select(F.posexplode("stats").alias("i", "x"))
        .groupBy("i")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
        .orderBy("i")
        .collect()
    )
    # rounded, so that the order of the sums does not show
    mean = np.round([r["mean"] for r in spread], 9)
    scale = np.round(np.maximum([r["scale"] for r in spread], 1e-3), 9)

    def fit(group: pa.Table) -> pa.Table:
        # shuffled rows come in any order; copies of a row are alike
        order = np.lexsort((group["label"].to_numpy(), group["print"].to_numpy(), group["doc_id"].to_numpy()))
        machine = _fitted(group.take(order), mean, scale)
        theta = np.concatenate([machine.weight[:, None], machine.factor], axis=1)
        return pa.table({"n": [len(group)], "level": [machine.level], "theta": [theta.tobytes()]})

    marked = rows.withColumn("print", F.xxhash64("slots", "values", "stats"))
    found = marked.groupBy("shard").applyInArrow(fit, "n long, level double, theta binary")
    n, level, theta = 0, 0.0, np.zeros(((1 << WORD_BITS) + len(STATS), 1 + RANK))
    for row in materialize(found, "machines").orderBy("n", "level").toLocalIterator():
        n += row["n"]
        level += row["n"] * row["level"]
        theta += row["n"] * np.frombuffer(row["theta"]).reshape(theta.shape)
    theta /= n
    return Machine(level / n, theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def fit_quality(docs: DataFrame, labels: DataFrame, shard_labelled: int = SHARD_LABELLED) -> Machine:
    """Fit on all training labels of ``docs``; without any, every text scores 0.5.

    Beyond ``shard_labelled`` of them the rows are dealt over shards of about that size, whose machines are averaged.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch):
                f = features(data, offsets)
                starts = np.searchsorted(f.row, np.arange(hi - lo + 1), "left").astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("label").cast(pa.int32()),
                        pa.ListArray.from_arrays(starts, pa.array(f.slot.astype(np.int32))),
                        pa.ListArray.from_arrays(starts, pa.array(f.value.astype(np.float32))),
                        pa.array(list(f.stats), pa.list_(pa.float64())),
                    ],
                    ["doc_id", "label", "slots", "values", "stats"],
                )

    bounded_batches(docs.sparkSession)
    known = train_labels(labels, "quality")
    shards = tasks_for(known.count(), shard_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(F.broadcast(known) if shards == 1 else known, "doc_id")
    found = rows.select("doc_id", "text", "label").mapInArrow(
        extract, "doc_id long, label int, slots array<int>, values array<float>, stats array<double>"
    )
    if shards == 1:
        return _fitted(found.drop("doc_id").toArrow())
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    written = materialize(dealt, "labelled")
    return _fitted(written.limit(0).toArrow()) if written.isEmpty() else _averaged(written)


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of ``docs`` with quality_score (0 to 1); existing ones of that name go.

    One pass without a shuffle. Null and empty texts are scored by their statistics alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(machine)
    name = "quality_score"
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != name))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch):
                part = batch.slice(lo, hi - lo)
                values = pa.array(sent.value.score(features(data, offsets)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, values], [*part.schema.names, name]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(score, f"{kinds}, {name} double")


def good_documents(docs: DataFrame, labels: DataFrame, pass_at: float = PASS_AT) -> DataFrame:
    """The rows of ``docs`` that score at least ``pass_at``, with their own columns."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.where(F.col("quality_score") >= pass_at).drop("quality_score")
