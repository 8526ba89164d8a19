"""Token ids as packed binary matrices, by best-fit decreasing over a segment tree.

Texts become ids with a separator; overlong ones are split losslessly into full pieces. Pieces
are dealt at random into shards of bounded size; in each shard the longest goes first, into the
bin whose room is the least that suffices, found in a segment tree over capacities. A row of the
result is one sequence: a fixed-width row of ids, the cumulative segment lengths, and positions
that restart with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, slices, tasks_for
from remitlens.llm.tokens import cut_points, word_tokenizer

CAPACITY = 2048
SHARD_DOCS = 2048
#: Ids and positions are little-endian unsigned 16-bit; vocabularies are checked to fit.
DTYPE = "<u2"
PAD = 0

SEQUENCE_SCHEMA = (
    "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


class CapacityTree:
    """Bins by remaining capacity; each node counts the bins below it."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def least(self, length: int) -> int:
        """The least room of ``length`` or more that some bin has, or -1."""
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each bin, longest items first."""
    tree = CapacityTree(capacity)
    waiting: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        room = tree.least(length)
        if room < 0:
            at, room = len(bins), capacity
            bins.append([])
        else:
            at = waiting[room].pop()
            tree.add(room, -1)
        bins[at].append(item)
        room -= length
        if room:
            waiting.setdefault(room, []).append(at)
            tree.add(room, 1)
    return bins


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int) -> DataFrame:
    """doc_id, piece, start, ids (binary) of every piece; a null text is a lone separator."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, hi, data, at in slices(batch):
                raw = data.tobytes()
                out: list[tuple] = []
                encoded = tokenizer.encode([raw[at[i] : at[i + 1]] for i in range(hi - lo)], separator)
                for key, ids in zip(keys[lo:hi], encoded, strict=True):
                    if len(ids) and int(ids.max()) >= 1 << 16:
                        raise ValueError("a token id does not fit 16 bits")
                    for n, start in enumerate(cut_points(len(ids), capacity)):
                        part = ids[start : start + capacity].astype(DTYPE)
                        out.append((key, n, start, part.tobytes()))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["doc_id", "piece", "start", "ids"],
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, ids binary")


def packed_matrices(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    separator: int = 0,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per sequence; every id of every document is in exactly one of them.

    input_ids and position_ids hold ``capacity`` numbers each, padded with 0 behind
    n_tokens; cu_seqlens starts at 0 and ends at n_tokens; segment k is piece pieces[k] of
    doc_ids[k], whose ids start at starts[k] in that document. Null ids stay null, repeated
    rows are packed one by one, an empty table gives no rows, other columns are not read.
    """
    shards = tasks_for(docs.count(), shard_docs)

    def pack(found: pa.Table) -> pa.Table:
        raw = found.column("ids").to_pylist()
        keys, pieces, starts = (found.column(c).to_pylist() for c in ("doc_id", "piece", "start"))
        shard = found.column("_shard")[0].as_py()
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        rows: dict[str, list] = {c: [] for c in _TYPES.names}
        for number, members in enumerate(best_fit_decreasing(lengths, capacity)):
            size = lengths[members]
            ends = np.concatenate([[0], np.cumsum(size)])
            total = int(ends[-1])
            places = np.zeros(capacity, DTYPE)
            places[:total] = np.arange(total) - np.repeat(ends[:-1], size)
            rows["sequence_id"].append((shard << 24) + number)
            rows["n_tokens"].append(total)
            rows["doc_ids"].append([keys[i] for i in members])
            rows["pieces"].append([pieces[i] for i in members])
            rows["starts"].append([starts[i] for i in members])
            rows["cu_seqlens"].append(ends.tolist())
            rows["input_ids"].append(b"".join(raw[i] for i in members).ljust(2 * capacity, b"\0"))
            rows["position_ids"].append(places.tobytes())
        return pa.Table.from_pydict(rows, schema=_TYPES)

    # a row's place in its input file decides its shard, so retries deal alike
    dealt = token_pieces(docs, tokenizer_path, capacity, separator).withColumn(
        "_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    )
    return dealt.groupBy("_shard").applyInArrow(pack, SEQUENCE_SCHEMA)


_TYPES = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("pieces", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("input_ids", pa.binary()),
        ("position_ids", pa.binary()),
    ]
)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the matrices as Parquet: fixed-width binary rows, any storage Spark reaches."""
    packed.write.parquet(path)
