"""Best-fit packing of token sequences with a swap-based local search.

Documents become token ids with a separator; longer ones are cut losslessly into full pieces.
Full pieces are sequences of their own. All others are dealt at random into shards of bounded
size; each shard is packed best-fit decreasing and then improved: documents move, change
places one for one, or two for one between underfull bins whenever that raises the sum of
squared fills, which drains the emptiest bins until they vanish. Bins that stay clearly
underfull go on, with their documents, to a next round over fewer shards. No task ever
holds more than one shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, materialize, slices, tasks_for
from remitlens.llm.tokens import cut_points, ids_crc32, word_tokenizer

CAPACITY = 2048
#: Pieces packed together in one task.
SHARD_PIECES = 4096
#: Bins filled less than this share of the capacity go on to the next round.
CARRY_BELOW = 0.95
#: Whole passes of the local search over a shard's underfull bins.
MAX_PASSES = 50

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, separator: int) -> DataFrame:
    """One row per piece of each document: ids, then the separator, cut at the capacity.

    A null text counts as empty, so it is one piece holding the separator alone. A null
    doc_id stays null; repeated rows stay repeated.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for lo, hi, data, at in slices(batch):
                raw = data.tobytes()
                texts = [raw[at[i] : at[i + 1]] for i in range(hi - lo)]
                out = []
                for key, ids in zip(keys[lo:hi], tokenizer.encode(texts, separator), strict=True):
                    for n, start in enumerate(cut_points(len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((key, n, start, len(part), ids_crc32(part)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column, kind)
                        for column, kind in zip(
                            zip(*out, strict=True),
                            (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                            strict=True,
                        )
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; remaining capacities in use are bits of one integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    used = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        above = used >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
            bins[at].append(item)
            room -= length
        else:
            at, room = len(bins), capacity - length
            bins.append([item])
        if room:
            by_room.setdefault(room, []).append(at)
            used |= 1 << room
    return bins


def _exchange(
    source: list[int], target: list[int], room: int, size: list[int]
) -> tuple[list[int], list[int]] | None:
    """Items to give to ``target`` and to take back, raising its fill by 1..room at most.

    The largest rise wins: a move, one for one, two for one, or one for two.
    """
    best, found = 0, None
    own = {size[i]: i for i in source}
    other = {size[i]: i for i in target}
    for a, item in own.items():
        if best < a <= room:
            best, found = a, ([item], [])
        for gain in range(min(room, a - 1), best, -1):
            if a - gain in other:
                best, found = gain, ([item], [other[a - gain]])
                break
    if best < room and len(source) > 1:
        for x in range(len(source)):
            for y in range(x):
                both = size[source[x]] + size[source[y]]
                for gain in range(min(room, both - 1), best, -1):
                    if both - gain in other:
                        best, found = gain, ([source[x], source[y]], [other[both - gain]])
                        break
    if best < room and len(target) > 1:
        for x in range(len(target)):
            for y in range(x):
                both = size[target[x]] + size[target[y]]
                for gain in range(room, best, -1):
                    if both + gain in own:
                        best, found = gain, ([own[both + gain]], [target[x], target[y]])
                        break
    return found


def local_search(
    bins: list[list[int]], lengths: np.ndarray, capacity: int, max_passes: int = MAX_PASSES
) -> list[list[int]]:
    """Exchange items between underfull bins until bins empty or no exchange helps.

    Every step takes from the emptiest bin and fills another further, so the sum of squared
    fills rises and the search ends. It stops as soon as the bins are as few as the total
    length allows.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    alive = len(bins)
    for _ in range(max_passes):
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=fill.__getitem__)
        changed = False
        for at, source in enumerate(open_bins):
            for target in reversed(open_bins[at + 1 :]):
                if alive <= least or not fill[source]:
                    break
                while fill[source] and fill[source] <= fill[target] < capacity:
                    found = _exchange(bins[source], bins[target], capacity - fill[target], size)
                    if not found:
                        break
                    give, take = found
                    bins[source] = [i for i in bins[source] if i not in give] + take
                    bins[target] = [i for i in bins[target] if i not in take] + give
                    gain = sum(size[i] for i in give) - sum(size[i] for i in take)
                    fill[source] -= gain
                    fill[target] += gain
                    changed = True
            if not fill[source]:
                alive -= 1
            if alive <= least:
                return [b for b in bins if b]
            if changed and at > 8:  # the emptiest bins first, then order anew
                break
        if not changed:
            break
    return [b for b in bins if b]


def swap_pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit_decreasing(lengths, capacity), lengths, capacity)


def _assign(pack: Callable, capacity: int, level: int, names: list[str]):
    """Pack one shard: number each bin, place its items one after the other."""

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        sequence = np.zeros(len(frame), np.int64)
        offset, fill = sequence.copy(), sequence.copy()
        for number, members in enumerate(pack(lengths, capacity)):
            ends = np.cumsum(lengths[members])
            sequence[members] = number
            offset[members] = ends - lengths[members]
            fill[members] = ends[-1]
        sequence += (level << 56) + (int(frame["_shard"].iloc[0]) << 24)
        return frame[names].assign(sequence_id=sequence, offset=offset, fill=fill)

    return assign


def in_rounds(
    items: DataFrame,
    pack: Callable[[np.ndarray, int], list[list[int]]],
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Pack rows having a ``length`` below the capacity; adds sequence_id, offset, fill.

    Rows are dealt to shards by a hash of their place in the written input, so neither null
    nor repeated keys pile up. Rounds end with a single shard, or when a round hardly
    thins out what it was given.
    """
    done: list[DataFrame] = []
    names = items.columns
    rest, n = items, items.count()
    level = 0
    while n:
        shards = tasks_for(n, shard_pieces)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
        # materialize() has fixed the rows and their files: the dealing repeats in retries
        dealt = rest.withColumn(
            "_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
        )
        packed = materialize(
            dealt.groupBy("_shard").applyInPandas(
                _assign(pack, capacity, level, names),
                f"{schema}, sequence_id long, offset long, fill long"
            ),
            "packed",
        )
        low = F.col("fill") < int(CARRY_BELOW * capacity)
        left = packed.where(low).count() if shards > 1 else 0
        if shards == 1 or not left or left > 0.5 * n:
            done.append(packed)
            break
        done.append(packed.where(~low))
        rest, n, level = packed.where(low).select(*names), left, level + 1
    if not done:
        return items.withColumns(
            {c: F.lit(0).cast("long") for c in ("sequence_id", "offset", "fill")}
        )
    return reduce(DataFrame.unionByName, done)


def best_fit_pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    separator: int = 0,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Place every piece of every document in a sequence of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Columns of
    ``docs`` other than doc_id and text are not read. An empty table gives no rows.
    """
    cut = materialize(pieces(docs, tokenizer_path, capacity, separator), "pieces")
    full = cut.where(F.col("length") >= capacity).select(
        "*",
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    packed = in_rounds(cut.where(F.col("length") < capacity), swap_pack, capacity, shard_pieces)
    return full.unionByName(packed.drop("fill"))
