"""Repeated passages removed by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Suffixes need not
be compared all against all: by a sliding minimum over hashes of short grams every string picks
one gram inside itself, its anchor, and equal strings pick the same one at the same place. Only
anchors met twice or more matter, and equal surroundings of an anchor collapse to the first.
The distinct surroundings go, by anchor, to buckets. In a bucket, shards of surroundings are
suffix-sorted each on its own; their transforms are merged by refining the interleave of the
shards, one symbol a round, without sorting suffixes again; after the rounds that make up
``length`` bytes, runs without a new boundary are the repeated strings. Symbols are grams of
twenty bytes, so five rounds take the place of a hundred. Anchors with very many
surroundings are settled string by string with grouped minima instead, in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import (
    bounded_batches,
    materialize,
    rolling_hash,
    slices,
    tasks_for,
)

LENGTH = 100
GRAM = 32
SYMBOL = 20
BUCKET_WINDOWS = 3000
SHARD_WINDOWS = 750
#: Anchors with more distinct surroundings than this are settled string by string.
HOT = 20_000


def anchors(
    data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors and their gram hashes: in every ``length`` bytes of a text the
    gram of least hash, the first among equals.
    """
    width = length - gram + 1
    place, hashes = [], []
    if len(data) >= gram:
        starts = np.arange(len(data) - gram + 1)
        whole = rolling_hash(data, starts, starts + gram)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = hi - lo - gram + 1
        if hi - lo < length:
            continue
        h = whole[lo : lo + n]
        bits = max(n.bit_length(), 1)
        keyed = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
        padded[:n] = keyed
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
        at = np.unique(least & np.uint64((1 << bits) - 1)).astype(np.int64)
        place.append(at + lo)
        hashes.append(h[at])
    if not place:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(place), np.concatenate(hashes)


def _occurrences(docs: DataFrame, length: int, around: bool) -> DataFrame:
    """h (and, if asked for, around, d, pos): the anchors of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - GRAM
        for batch in batches:
            ids = batch.column("_d").to_numpy()
            for lo, _, data, offsets in slices(batch):
                at, h = anchors(data, offsets, length)
                columns = [pa.array(h.view(np.int64))]
                if around:
                    row = np.searchsorted(offsets, at, "right") - 1
                    first = np.maximum(at - reach, offsets[row])
                    last = np.minimum(at + length, offsets[row + 1])
                    hashed = rolling_hash(data, first, last) + (at - first).astype(np.uint64)
                    columns += [
                        pa.array(hashed.view(np.int64)),
                        pa.array(ids[lo + row]),
                        pa.array((at - offsets[row]).astype(np.int32)),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["h", "around", "d", "pos"] if around else ["h"]
    schema = "h long, around long, d long, pos int" if around else "h long"
    return docs.select("_d", "text").mapInArrow(find, schema)


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable ascending order of whole numbers from -1 below 2^32 - 1, by two counting passes."""
    shifted = (values + 1).astype(np.uint32)
    order = np.argsort((shifted & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
    high = (shifted >> np.uint32(16)).astype(np.uint16)
    if not high.any():
        return order
    return order[np.argsort(high[order], kind="stable")]


def shard_order(symbols: np.ndarray, following: np.ndarray, rounds: int) -> np.ndarray:
    """Suffix numbers of one shard sorted by their first ``rounds`` symbols.

    ``symbols`` holds each suffix's first symbol, -1 at an end; ``following`` the suffix behind
    that symbol (an end follows itself).
    """
    at, keys = np.arange(len(symbols)), []
    for _ in range(rounds):
        keys.append(symbols[at])
        at = following[at]
    order = np.arange(len(symbols))
    for key in reversed(keys):
        order = order[stable_order(key[order])]
    return order


def merge_shards(
    transforms: list[np.ndarray], rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' sorted suffixes, and where runs equal to ``rounds`` symbols start.

    ``transforms`` are the shards' preceding symbols in suffix order, -1 at the start of a
    string. Each round deals the interleave out by preceding symbol, stably; ends come first,
    as the suffixes that no symbol leads to.
    """
    sizes = [len(t) for t in transforms]
    ends = [int((t < 0).sum()) for t in transforms]  # as many strings start as end
    z = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    fresh = np.zeros(len(z), bool)
    fresh[:1] = True
    lead = np.repeat(np.arange(len(ends), dtype=np.uint16), ends)
    flat = np.concatenate(transforms) if transforms else np.zeros(0, np.int64)
    for _ in range(rounds):
        place = np.empty(len(z), np.int64)
        by_shard = np.argsort(z, kind="stable")
        place[by_shard] = np.arange(len(z))  # the i-th of shard s is the i-th of its transform
        merged = flat[place]
        group = np.cumsum(fresh)
        goes = np.flatnonzero(merged >= 0)
        order = goes[stable_order(merged[goes])]
        z = np.concatenate([lead, z[order]])
        fresh = np.ones(len(z), bool)
        symbol, old = merged[order], group[order]
        head = len(lead)
        fresh[head + 1 :] = (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])
        fresh[1:head] = False
    return z, fresh


def repeated_strings(
    windows: list[bytes],
    places: np.ndarray,
    length: int = LENGTH,
    shard_windows: int = SHARD_WINDOWS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, start and stop of the ranges covered by strings that also start earlier.

    ``places`` are the windows' own first places, in one numbering of all texts of the bucket,
    so that windows which overlap in a text do not count as repeats of each other. Each window is twenty strings of symbols, one per phase; merging orders all their suffixes.
    """
    rounds = length // SYMBOL
    n = len(windows)
    sizes = np.fromiter(map(len, windows), np.int64, n)
    data = np.frombuffer(b"".join(windows), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)])
    # suffixes start at every byte up to the end of the window: the ends are the last SYMBOL
    owner = np.repeat(np.arange(n), sizes + 1)
    offset = np.arange(len(owner)) - np.repeat(base[:-1] + np.arange(n), sizes + 1)
    room = sizes[owner] - offset
    grams = np.flatnonzero(room >= SYMBOL)
    begin = base[owner[grams]] + offset[grams]
    symbols = np.full(len(owner), -1, np.int64)
    symbols[grams] = np.unique(rolling_hash(data, begin, begin + SYMBOL), return_inverse=True)[1]
    following = np.arange(len(owner))
    following[grams] += SYMBOL
    before = np.full(len(owner), -1, np.int64)
    led = np.flatnonzero(offset >= SYMBOL)
    before[led] = symbols[led - SYMBOL]
    firsts = np.searchsorted(owner, np.arange(n + 1))
    transforms, numbers = [], []
    for lo in range(0, n, shard_windows):
        a, b = firsts[lo], firsts[min(lo + shard_windows, n)]
        order = a + shard_order(symbols[a:b], following[a:b] - a, rounds)
        transforms.append(before[order])
        numbers.append(order)
    z, fresh = merge_shards(transforms, rounds)
    suffix = np.empty(len(z), np.int64)
    suffix[np.argsort(z, kind="stable")] = np.concatenate(numbers)
    group = np.cumsum(fresh) - 1
    long = room[suffix] >= length
    suffix, group = suffix[long], group[long]
    place = places[owner[suffix]] + offset[suffix]
    earliest = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(earliest, group, place)
    late = suffix[place > earliest[group]]
    late.sort()
    of, at = owner[late], offset[late]
    if not len(late):
        return of, at, at
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] > at[:-1] + length)))
    last = np.append(first[1:] - 1, len(late) - 1)
    return of[first], at[first], at[last] + length


def merged_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs; touching ranges join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(new[1:] - 1, len(ends) - 1)]


def _settle_buckets(windows: DataFrame, n: int, length: int) -> DataFrame:
    """d, start, stop: repeated ranges of the windows, bucket by bucket."""

    def settle(found: pa.Table) -> pa.Table:
        ids, base = found.column("d").to_numpy(), found.column("base").to_numpy()
        text = np.unique(ids, return_inverse=True)[1]
        places = (text.astype(np.int64) << 32) + base
        of, start, stop = repeated_strings(found.column("window").to_pylist(), places, length)
        columns = (ids[of], (base[of] + start).astype(np.int32), (base[of] + stop).astype(np.int32))
        return pa.table([pa.array(c) for c in columns], ["d", "start", "stop"])

    buckets = tasks_for(n, BUCKET_WINDOWS)
    return (
        windows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(settle, "d long, start int, stop int")
    )


def _settle_strings(windows: DataFrame, length: int) -> DataFrame:
    """The same for hot anchors: each string's first place by a grouped minimum."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, base, pos = (batch.column(c).to_numpy() for c in ("h", "d", "base", "pos"))
            data = [np.frombuffer(w, np.uint8) for w in batch.column("window").to_pylist()]
            for i, window in enumerate(data):
                at = np.arange(len(window) - length + 1)
                if not len(at):
                    continue
                shift = pos[i] - base[i] - at  # the anchor's place in the string
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), h[i])),
                        pa.array(shift.astype(np.int32)),
                        pa.array(rolling_hash(window, at, at + length).view(np.int64)),
                        pa.array(np.full(len(at), d[i])),
                        pa.array((base[i] + at).astype(np.int32)),
                    ],
                    ["h", "shift", "string", "d", "start"],
                )

    every = materialize(
        windows.mapInArrow(strings, "h long, shift int, string long, d long, start int"), "strings"
    )
    key = ["h", "shift", "string"]
    first = every.groupBy(*key).agg(F.min(F.struct("d", "start")).alias("first"))
    late = every.join(first, key).where(F.struct("d", "start") > F.col("first"))
    return late.select("d", "start", (F.col("start") + length).alias("stop"))


_DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    kept, at = hashlib.sha256(), 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), int((ends - starts).sum()), len(starts), kept.hexdigest()


def _keyed(docs: DataFrame) -> DataFrame:
    """_d, doc_id, text with a unique _d that orders documents as doc_id does, nulls last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    unclear = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if unclear.isEmpty():
        return rows.withColumn("_d", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("_d", F.monotonically_increasing_id()), "keyed")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row.

    ``spans`` are the removed byte ranges. Null counts as empty. Rows with the same id are
    documents of their own, in text order; null ids come last. An empty table gives no rows.
    ``length`` must be a multiple of 20, from 40.
    """
    if length % SYMBOL or length < GRAM:
        raise ValueError("length must be a multiple of 20, from 40")
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    reach = length - GRAM
    twice = materialize(
        _occurrences(keyed, length, False)
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h"),
        "twice",
    )
    hits = materialize(_occurrences(keyed, length, True).join(twice, "h"), "hits")
    distinct = materialize(
        hits.groupBy("h", "around").agg(F.min(F.struct("d", "pos")).alias("first")), "distinct"
    )
    several = materialize(
        distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several"
    )
    checked = distinct.join(several, "h").select(
        F.col("first.d").alias("d"), F.col("first.pos").alias("pos"), "h", (F.col("n") > HOT).alias("hot")
    )
    copies = (
        hits.join(distinct, ["h", "around"])
        .where(F.struct("d", "pos") > F.col("first"))
        .select("d", "pos", F.lit(None).cast("long").alias("h"), F.lit(False).alias("hot"))
    )
    marks = (
        checked.unionByName(copies)
        .groupBy("d")
        .agg(F.collect_list(F.struct("pos", "h", "hot")).alias("marks"))
    )

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch):
                raw, rows = data.tobytes(), []
                marked = batch.column("marks").slice(lo, hi - lo).to_pylist()
                for i, found in enumerate(marked):
                    text = raw[offsets[i] : offsets[i + 1]]
                    at = np.array([m["pos"] for m in found or () if m["h"] is None], np.int64)
                    a = np.maximum(at - reach, 0)
                    b = np.minimum(at + length, len(text))
                    whole = b - a >= length
                    a, b = merged_ranges(a[whole], b[whole])
                    check = [m for m in found or () if m["h"] is not None]
                    rows.append(
                        (*_digest(text, a, b), text if check else None, a.tolist(), b.tolist(), check)
                    )
                part = batch.slice(lo, hi - lo)
                columns = [part.column("_d"), part.column("doc_id")]
                columns += [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    mark = pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("hot", pa.bool_())])
    kinds = (
        pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
        pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(mark),
    )
    names = ["_d", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "body", "a", "b", "checks"]
    prepared = materialize(
        keyed.join(marks, keyed["_d"] == marks["d"], "left")
        .select("_d", "doc_id", "text", "marks")
        .mapInArrow(
            prepare,
            f"_d long, doc_id long, {_DIGEST}, body binary, a array<int>, b array<int>, "
            "checks array<struct<pos:int,h:long,hot:boolean>>",
        ),
        "prepared",
    )
    pending = F.size("checks") > 0
    base = F.greatest(F.col("c.pos") - reach, F.lit(0))
    windows = materialize(
        prepared.where(pending)
        .select(F.col("_d").alias("d"), "body", F.explode("checks").alias("c"))
        .select(
            "d",
            F.col("c.h").alias("h"),
            F.col("c.hot").alias("hot"),
            F.col("c.pos").alias("pos"),
            base.alias("base"),
            F.substring("body", base + 1, F.col("c.pos") + length - base).alias("window"),
        ),
        "windows",
    )
    usual = windows.where(~F.col("hot"))
    ranges = [_settle_buckets(usual, usual.count(), length)]
    if not windows.where("hot").isEmpty():
        ranges.append(_settle_strings(windows.where("hot"), length))
    settled = (
        reduce(DataFrame.unionByName, ranges)
        .groupBy("d")
        .agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, a, b, more in zip(
                *(batch.column(c).to_pylist() for c in ("body", "a", "b", "more")), strict=True
            ):
                more = more or []
                a, b = merged_ranges(
                    np.array(a + [m["start"] for m in more], np.int64),
                    np.array(b + [m["stop"] for m in more], np.int64),
                )
                rows.append((*_digest(body, a, b), a.tolist(), b.tolist()))
            columns = [batch.column("doc_id")]
            columns += [
                pa.array(c, k)
                for c, k in zip(zip(*rows, strict=True), (*kinds[:4], *kinds[5:7]), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, [names[1], *names[2:6], "a", "b"])

    ready = prepared.where(~pending).drop("_d", "body", "checks")
    late = (
        prepared.where(pending)
        .join(settled, prepared["_d"] == settled["d"], "left")
        .select("doc_id", "body", "a", "b", "more")
        .mapInArrow(finish, f"doc_id long, {_DIGEST}, a array<int>, b array<int>")
    )
    return ready.unionByName(late).withColumn("spans", F.arrays_zip("a", "b")).drop("a", "b")
