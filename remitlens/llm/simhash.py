"""SimHash near-duplicates found through the anchors of a covering code.

Texts with equal fingerprints collapse first. Two fingerprints that differ in at most three bits
differ in at most one bit in one of their 32-bit halves. The anchors of a half are the words of
a perfect Hamming code on 31 bits with one free bit: every half lies within one bit of an
anchor, its home, and then the other half lies within two bits of that same anchor. So each
fingerprint goes to the home of each half, and as a probe to every anchor within two bits; they
are compared per anchor. Crowded anchors are split by bytes of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import bounded_batches, materialize, slices
from remitlens.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes) -> int:
    """64 majority bits over the XXH64 of all word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(_FOLD).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= SHINGLE:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[: n - SHINGLE + 1].tolist()
    last = ends[SHINGLE - 1 :].tolist()
    hashes = np.fromiter(
        (xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last, strict=True)),
        np.uint64,
        len(first),
    )
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``fingerprint`` as a signed long; null texts have no words.

    The text goes when it is not to be kept; an existing fingerprint column is replaced.
    """
    name = "fingerprint"
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != name))
    out = [f for f in kept.schema if keep_text or f.name != "text"]
    names = [f.name for f in out]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(batch):
                raw = data.tobytes()
                values = [fingerprint(raw[at[i] : at[i + 1]]) for i in range(hi - lo)]
                signed = np.array(values, np.uint64).view(np.int64)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(signed)], [*names, name]
                )

    bounded_batches(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return kept.mapInArrow(compute, f"{kinds}, {name} long")


#: The Hamming code has parity column p + 1 at bit p, so a syndrome names the bit to flip.
HALF = 32
CODE_BITS = 31
#: An anchor that is home to more fingerprints than this is compared in groups of its own.
CROWDED = 64


def _syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the columns of the set bits among the low 31; 0 for anchors."""
    out = np.zeros(len(half), np.int64)
    for p in range(CODE_BITS):
        out ^= np.where((half >> p) & 1, p + 1, 0)
    return out


def home(half: np.ndarray) -> np.ndarray:
    """The anchor within one bit: the code word next to the low 31 bits, the free bit kept."""
    s = _syndrome(half)
    return half ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)


def probes(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every anchor within two bits of each half."""
    s = _syndrome(half)
    rows = np.arange(len(half))
    free = np.int64(1) << CODE_BITS
    near = home(half)
    index, anchor = [rows], [near]
    index.append(rows)
    anchor.append(near ^ free)
    # two flips among the 31: columns i and j with i ^ j equal to the syndrome
    for i in range(1, CODE_BITS + 1):
        j = s ^ i
        pick = (s > 0) & (j > i)
        index.append(rows[pick])
        anchor.append(half[pick] ^ (1 << (i - 1)) ^ (np.int64(1) << (j[pick] - 1)))
    return np.concatenate(index), np.concatenate(anchor)


def _cover(nodes: DataFrame, as_home: bool) -> DataFrame:
    """side, anchor, fp: the home of each half, or all anchors it probes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for side in (0, 1):
                half = (fp.view(np.uint64) >> np.uint64(HALF * side)).astype(np.int64) & 0xFFFFFFFF
                if as_home:
                    index, anchor = np.arange(len(fp)), home(half)
                else:
                    index, anchor = probes(half)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor | (side << 40), pa.int64()),
                        pa.array(fp[index], pa.int64()),
                    ],
                    ["anchor", "fp"],
                )

    return nodes.select("fp").mapInArrow(place, "anchor long, fp long")


def _star(frame):
    """Links of one group of fingerprints, as edges from each to the least of its component."""
    import pandas as pd

    fp = np.unique(frame["fp"].to_numpy(np.int64))
    bits = fp.view(np.uint64)
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    for at in range(0, len(fp), 256):
        close = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= MAX_BITS
        for i, j in zip(*np.nonzero(close), strict=True):
            x, y = find(at + int(i)), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
    top = np.array([find(i) for i in range(len(fp))], np.int64)
    linked = top != np.arange(len(fp))
    return pd.DataFrame({"a": fp[linked], "b": fp[top[linked]]})


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a, b: edges that join exactly the distinct fingerprints linked at three bits or fewer.

    ``nodes`` holds each fingerprint once, in column fp. Around ordinary anchors each
    probe meets at most ``crowded`` homes. Crowded anchors are split four ways by the bytes of the
    other half, one of which must agree, and give a spanning star per group, not all pairs.
    """
    homes = materialize(_cover(nodes, True), "homes")
    probing = materialize(_cover(nodes, False), "probes")
    full = (
        homes.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > crowded)
        .select("anchor")
    )
    full = materialize(full, "crowded")
    a = homes.withColumnRenamed("fp", "a")
    b = probing.withColumnRenamed("fp", "b")
    crowd = not full.isEmpty()
    if crowd:
        a, b = a.join(full, "anchor", "left_anti"), b.join(full, "anchor", "left_anti")
    met = a.join(
        b,
        (a["anchor"] == b["anchor"])
        & (a["a"] != b["b"])
        & (F.bit_count(a["a"].bitwiseXOR(b["b"])) <= MAX_BITS),
    ).select("a", "b")
    if not crowd:
        return met
    other = F.when(
        F.col("anchor") < (1 << 40), F.shiftrightunsigned("fp", HALF)
    ).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    split = (
        probing.join(full, "anchor")
        .withColumn("other", other)
        .select(
            "anchor",
            "fp",
            F.posexplode(
                F.array(*(F.shiftrightunsigned("other", 8 * k).bitwiseAND(255) for k in range(4)))
            ).alias("byte", "value"),
        )
    )
    stars = split.groupBy("anchor", "byte", "value").applyInPandas(_star, "a long, b long")
    return met.unionByName(stars)


def with_components(printed: DataFrame) -> DataFrame:
    """Add component_id: the least doc_id reachable over links, itself included.

    ``printed`` is a written table with doc_id and fingerprint. Null ids are linked
    like others but never name a component, unless all of its ids are null.
    """
    firsts = materialize(
        printed.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")),
        "distinct",
    )
    roots = components(links(firsts.select("fp")))
    linked = materialize(
        roots.join(firsts, roots["node"] == firsts["fp"]).select("fp", "root", "first"), "linked"
    )
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    inside = linked.join(least, "root").select("fp", "component_id", F.lit(True).alias("found"))
    named = materialize(
        firsts.join(inside, "fp", "left").select(
            F.col("fp").alias("fingerprint"),
            F.when(F.col("found"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"),
        ),
        "components",
    )
    return printed.join(named, "fingerprint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row, repeated rows included.

    Null and empty texts have no words: fingerprint zero, linked like any other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    printed = materialize(fingerprints(rows, keep_text=False), "fingerprints")
    return with_components(printed).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
