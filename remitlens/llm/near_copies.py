"""Near copies: texts whose sets of word shingles reach a similarity (Jaccard), in steps.

Equal word sequences collapse first. Bands of min-hashes bring together texts that may be alike;
enough bands are drawn that a pair just at the similarity shares none with a chance below ``MISS``.
SimHash fingerprints linked through the anchors of a covering code bring together the closest ones,
whatever their bands. Candidates pass a look at the share of equal min-hashes, then their whole shingle sets are
compared, so no pair below the similarity is linked.

The work grows with the members of the buckets, not with their pairs. In the first bands, and among
texts of one fingerprint, every member meets the least one, which joins most families. After that only buckets that still hold several
components go on: in small ones all members meet, in crowded ones all meet one of them, drawn anew
per bucket, and the bucket is divided by further min-hashes, time after time, until the parts are
small; a member is in one part of each bucket, so nothing multiplies. What division tore apart is settled last: in crowded
buckets that still hold several components, whoever is outside the commonest one is compared with every
member, block by block, and a block returns no more edges than join its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.llm import simhash
from remitlens.llm.common import bounded_batches, materialize, rolling_hash, slices, word_spans
from remitlens.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: Min-hashes of one band, and the chance that no band shows a pair just at the similarity.
BAND_ROWS = 6
MISS = 1e-4
#: Bands whose buckets link their members to the least one before all else.
FIRST_BANDS = 8
#: Members of a bucket that meet each other; larger ones are divided.
SMALL = 8
#: How often a crowded bucket is divided at most, each time by two further min-hashes.
DIVISIONS = 4
#: Share of the similarity that equal min-hashes must show; six standard deviations below it.
GLANCE = 0.78
#: Members of a crowded bucket on either side of one comparison of blocks, about, and the columns
#: of shingles held at a time.
BLOCK = 256
COLUMNS = 2048

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * _MIX
    value = (value ^ (value >> np.uint64(29))) * _MIX
    return value ^ (value >> np.uint64(32))


def shingles(
    data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word shingle; a text of fewer words is one shingle."""
    lower = _LOWER[data]
    begin, end, row = word_spans(lower, offsets, ~_SPACE)
    if not len(begin):
        return np.zeros(0, np.uint64), row
    word = _mixed(rolling_hash(lower, begin, end))
    first = np.searchsorted(row, row, "left")
    count = np.searchsorted(row, row, "right") - first
    place = np.arange(len(row)) - first
    at = np.flatnonzero(np.where(count >= size, place + size <= count, place == 0))
    width = np.minimum(count[at], size)
    value = width.astype(np.uint64)
    for k in range(size):
        inside = np.minimum(at + k, len(word) - 1)
        value = np.where(k < width, value * _STEP + word[inside], value)
    return _mixed(value), row[at]


def band_count(similarity: float) -> int:
    return max(1, ceil(log(MISS) / log(1 - min(similarity, 0.999) ** BAND_ROWS)))


def band_keys(
    hashes: np.ndarray, row: np.ndarray, bands: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have shingles, for each one key per band, and a byte of every min-hash."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    keys = np.zeros((len(start), bands), np.uint64)
    glance = np.zeros((len(start), bands * BAND_ROWS), np.uint8)
    if not len(start):
        return row, keys, glance
    draws = np.random.default_rng(42).integers(0, 1 << 63, (bands * BAND_ROWS, 2), np.uint64)
    for i, (a, b) in enumerate(draws):
        least = np.minimum.reduceat(_ordered(hashes, a, b), start)
        keys[:, i // BAND_ROWS] = keys[:, i // BAND_ROWS] * _STEP + least
        glance[:, i] = (_mixed(least) >> np.uint64(56)).astype(np.uint8)
    return row[start], _mixed(keys + np.arange(bands, dtype=np.uint64) * _MIX), glance


def _ordered(hashes: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """A random order of the hashes: xor before the odd factor, so that factors act apart."""
    return (hashes ^ b) * (a * np.uint64(2) + np.uint64(1))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets without repeats; that of two empty sets is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _signed(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """given (the row of ``docs``), doc_id, node, words (digest of the word sequence), bands, glance,
    print (the SimHash fingerprint).

    A text without words has no bands.
    """
    rows = docs.select(
        F.struct("*").alias("given"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("node"),
    )
    names = rows.columns

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column("given").field("text")], ["text"])
            for lo, hi, data, at in slices(text):
                raw = _LOWER[data].tobytes()
                lines = [b" ".join(raw[at[i] : at[i + 1]].split()) for i in range(hi - lo)]
                rows, keys, bytes_ = band_keys(*shingles(data, at, size), bands)
                found: list[list[int]] = [[] for _ in range(hi - lo)]
                seen: list[bytes] = [b""] * (hi - lo)
                for r, k, g in zip(rows.tolist(), keys.view(np.int64).tolist(), bytes_, strict=True):
                    found[r], seen[r] = k, g.tobytes()
                prints = np.array([simhash.fingerprint(line) for line in lines], np.uint64)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in names),
                        pa.array([xxh3_128_digest(line) for line in lines], pa.binary()),
                        pa.array(found, pa.list_(pa.int64())),
                        pa.array(seen, pa.binary()),
                        pa.array(prints.view(np.int64)),
                    ],
                    [*names, "words", "bands", "glance", "print"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(sign, f"{kinds}, words binary, bands array<long>, glance binary, print long")


def _both(pairs: DataFrame, one: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with the column of both texts, as left and right."""
    left = one.select(F.col("node").alias("a"), F.col(column).alias("left"))
    right = one.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _glanced(pairs: DataFrame, one: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose min-hashes agree often enough; few others are left."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [b"".join(batch.column(c).to_pylist()) for c in ("left", "right")]
            left, right = (np.frombuffer(x, np.uint8).reshape(len(batch), -1) for x in sides)
            near = (left == right).mean(axis=1) >= GLANCE * similarity if len(batch) else []
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return _both(pairs, one, "glance").mapInArrow(compare, "a long, b long")


def _alike(
    pairs: DataFrame, firsts: DataFrame, texts: DataFrame, size: int, similarity: float
) -> DataFrame:
    """Those of the pairs (a, b) whose texts reach the similarity."""

    def sets(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
        found = []
        for lo, hi, data, at in slices(batch, column):
            value, row = shingles(data, at, size)
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            found += [np.unique(value[edge[i] : edge[i + 1]]) for i in range(hi - lo)]
        return found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [
                similarity_of(x, y) >= similarity
                for x, y in zip(sets(batch, "left"), sets(batch, "right"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    glanced = materialize(_glanced(pairs, firsts, similarity), "glanced")
    met = glanced.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    used = materialize(texts.join(materialize(met, "met"), "node", "left_semi"), "texts")
    return _both(glanced, used, "text").mapInArrow(compare, "a long, b long")


def _shared(members: DataFrame) -> DataFrame:
    """Members of the buckets of several, with the least one."""
    kept = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    return members.join(kept.where("n > 1").drop("n"), "key")


def _contested(members: DataFrame) -> DataFrame:
    """Members of the buckets of several components, with the size of the bucket and its pivot.

    The pivot is a member drawn by a hash of bucket and node.
    """
    drawn = F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))
    several = F.min("root") < F.max("root")
    kept = members.groupBy("key").agg(
        F.count("*").alias("n"), drawn["node"].alias("pivot"), several.alias("several")
    )
    return members.join(kept.where("several").drop("several"), "key")


def _ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _meetings(buckets: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) to compare in buckets (key, band, node, root, n, pivot) of several components."""
    pairs, level = [], buckets
    for division in range(DIVISIONS + 1):
        pivots = level.where("node = pivot").select("key", F.col("root").alias("pivot_root"))
        stars = level.join(pivots, "key").where("root <> pivot_root")
        pairs.append(stars.select(*_ordered_pair("node", "pivot")))
        few = level.where(F.col("n") <= SMALL).select("key", "node", "root")
        other = few.select("key", F.col("node").alias("b"), F.col("root").alias("other"))
        met = few.join(other, "key").where("node < b and root <> other")
        pairs.append(met.select(F.col("node").alias("a"), "b"))
        crowded = level.where(F.col("n") > SMALL).drop("n", "pivot")
        if division == DIVISIONS or crowded.isEmpty():
            break
        if division == 0:
            # the min-hashes behind those of the band, round the end; two a division
            behind = (F.col("band") + 1) * BAND_ROWS % F.octet_length("glance") + 1
            circle = F.concat("glance", "glance")
            further = F.substring(circle, behind.cast("int"), F.lit(2 * DIVISIONS))
            crowded = crowded.join(firsts.select("node", "glance"), "node")
            crowded = crowded.withColumn("further", further).drop("glance", "band")
        two = F.substring("further", 2 * division + 1, 2)
        parts = crowded.withColumn("key", F.xxhash64("key", two))
        level = materialize(_contested(parts), "divided")
    return reduce(DataFrame.unionByName, pairs).distinct()


def _printed(firsts: DataFrame) -> DataFrame:
    """Pairs (a, b) to compare by SimHash: texts of one fingerprint, and of linked fingerprints.

    Each text of a fingerprint meets the least one, and those of linked fingerprints meet.
    """
    known = firsts.where(F.size("bands") > 0).select("node", F.col("print").alias("fp"))
    prints = materialize(known.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = known.join(prints, "fp").where("node <> first")
    left = prints.withColumnsRenamed({"fp": "a", "first": "left"})
    right = prints.withColumnsRenamed({"fp": "b", "first": "right"})
    linked = simhash.links(prints.select("fp")).join(left, "a").join(right, "b").where("left <> right")
    return equal.select(F.col("first").alias("a"), F.col("node").alias("b")).unionByName(
        linked.select(*_ordered_pair("left", "right"))
    )


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle of the texts."""
    owners, values, done = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for lo, hi, data, at in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        value, row = shingles(data, at, size)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        owners.append(row[new] + done)
        values.append(value[new])
        done += hi - lo
    return np.concatenate(owners), np.concatenate(values)


def _overlaps(left: tuple, right: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Shingles that each text on the left shares with each on the right."""
    met = np.intersect1d(left[1], right[1])
    both = np.zeros(shape, np.float32)
    sides = []
    for (owner, value), n in zip((left, right), shape, strict=True):
        known = np.isin(value, met)
        place = np.searchsorted(met, value[known])
        order = np.argsort(place, kind="stable")
        sides.append((owner[known][order], place[order], n))
    for at in range(0, len(met), COLUMNS):
        parts = []
        for owner, place, n in sides:
            lo, hi = np.searchsorted(place, [at, at + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[lo:hi], place[lo:hi] - at] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both


def _across(members: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: edges that join the components of each bucket whose texts reach the similarity.

    ``members`` (key, node, root) of whole buckets. A pair of two components has at least one member outside
    the commonest one, so only those meet all the others: in blocks of about ``BLOCK`` each, every block on
    one side with every block on the other, whatever the size of the bucket.
    """
    parts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    sized = parts.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("major"),
        F.sum("n").alias("n"),
        (F.sum("n") - F.max("n")).alias("n_minor"),
    )
    sized = sized.where("n_minor > 0").select(
        "key",
        "major",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("n_parts"),
        F.ceil(F.col("n_minor") / BLOCK).cast("int").alias("n_blocks"),
    )
    kept = materialize(members.join(sized, "key"), "torn")

    def dealt(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    names = ["key", "node", "root"]
    minor = kept.where("root <> major").select(
        *names, F.lit(True).alias("minor"), dealt("n_blocks").alias("block"), every("n_parts").alias("part")
    )
    whole = kept.select(
        *names, F.lit(False).alias("minor"), dealt("n_parts").alias("part"), every("n_blocks").alias("block")
    )
    used = texts.join(kept.select("node").distinct(), "node", "left_semi")
    placed = minor.unionByName(whole).join(used, "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        left, right = group.filter(group["minor"]), group.filter(pc.invert(group["minor"]))
        sets = [_sets(side["text"].combine_chunks(), size) for side in (left, right)]
        shape = len(left), len(right)
        both = _overlaps(*sets, shape).astype(np.float64)
        counts = [np.bincount(owner, minlength=n) for (owner, _), n in zip(sets, shape, strict=True)]
        either = counts[0][:, None] + counts[1][None, :] - both
        near = both / np.maximum(either, 1) >= similarity
        nodes = [side["node"].to_numpy() for side in (left, right)]
        roots = [side["root"].to_numpy() for side in (left, right)]
        near &= roots[0][:, None] != roots[1][None, :]
        joined: dict[int, int] = {}

        def find(x: int) -> int:
            while joined.get(x, x) != x:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        edges = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = find(int(roots[0][i])), find(int(roots[1][j]))
            if x != y:
                joined[max(x, y)] = min(x, y)
                edges.append((int(nodes[0][i]), int(nodes[1][j])))
        return pa.table(
            {"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())}
        )

    return placed.groupBy("key", "block", "part").applyInArrow(compare, "a long, b long")


def _links(firsts: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """a, b: edges that join the texts linked at the similarity.

    ``firsts`` (node, bands, glance, print) has no equal ones; ``texts`` (node, text) has all of them.
    """
    members = firsts.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = materialize(_shared(members), "buckets")
    stars = buckets.where((F.col("band") < FIRST_BANDS) & (F.col("node") != F.col("least")))
    stars = stars.select(F.col("least").alias("a"), F.col("node").alias("b"))
    stars = stars.unionByName(_printed(firsts)).distinct()
    edges = materialize(_alike(stars, firsts, texts, size, similarity), "star_links")
    roots = components(edges)
    placed = buckets.select("key", "band", "node").join(roots, "node", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    mixed = materialize(_contested(placed), "mixed")
    rest = _alike(_meetings(mixed, firsts), firsts, texts, size, similarity)
    edges = materialize(edges.unionByName(rest), "links")
    torn = mixed.where(F.col("n") > SMALL).select("key", "node").join(components(edges), "node", "left")
    torn = materialize(torn.withColumn("root", F.coalesce("root", "node")), "crowded")
    return materialize(edges.unionByName(_across(torn, texts, size, similarity)), "all_links")


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one of the least doc_id.

    Rows are linked when their shingle sets reach the similarity; texts without words, null ones
    too, are linked with each other. Among rows with the least doc_id the first written stays; a
    null doc_id counts as the greatest. Columns are those of ``docs``, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kept = materialize(_signed(docs, size, band_count(similarity)), "signed")
    named = materialize(kept.groupBy("words").agg(F.min("node").alias("node")), "distinct")
    firsts = kept.select("node", "bands", "glance", "print").join(named.select("node"), "node", "left_semi")
    texts = kept.select("node", "given.text")
    roots = components(_links(materialize(firsts, "firsts"), texts, size, similarity))
    of_words = named.join(roots, "node", "left").select(
        "words", F.coalesce("root", "node").alias("component")
    )
    stay = (
        kept.select("node", "doc_id", "words")
        .join(of_words, "words")
        .groupBy("component")
        .agg(F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("node"))
        .select("node")
    )
    return kept.join(stay, "node", "left_semi").select("given.*")
