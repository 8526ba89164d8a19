"""Merkle manifest of a dataset: a digest tree per source, one above the sources, a proof per row.

Every row is a leaf. Per source the leaves ascend by id; runs of ``FAN`` consecutive nodes become
one node until a single one is left, and those of all sources, in order, do likewise. Per level,
lag and lead columns of every fixed offset, masked by the slot of the node in its run and the length
of the run, are the siblings; the row in the first slot hashes its parent.

A window never holds more than a run, so the size of a source does not matter. Positions come from
one range-partitioned sort of the digests. A level is a sixteenth of the one below; proofs go down
the levels once per run, not once per row, and the lowest siblings are added in the last
projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.llm.common import materialize
from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import with_row_index

#: Nodes that make one parent.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*(encoded(f) for f in fields))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and altered: the leaf after tampering, null where nothing is changed.

    Of the rows whose id has a checksum (CRC-32) divisible by 5, tampering lower-cases A-Z in the
    text. Other columns of ``docs`` take no part.
    """
    fields = [F.col(c) for c in FIELDS]
    lowered = F.translate("text", _UPPER, _LOWER)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & (lowered != F.col("text"))
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        leaf_digest(fields).alias("leaf"),
        F.when(tampered, leaf_digest([*fields[:-1], lowered])).alias("altered"),
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, side: digest(side["left"], node, side["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    sides = F.transform(path, lambda side: F.concat(side["left"], side["right"]))
    return F.sha2(F.array_join(sides, ""), 256)


def _siblings(nodes: DataFrame) -> DataFrame:
    """Nodes of groups of several, with the digests left and right of them in their run.

    ``nodes`` has grp, pos (from 0 in its group), n (nodes of the group on this level), node.
    """
    run = F.call_function("div", F.col("pos"), F.lit(FAN))
    placed = (
        nodes.where(F.col("n") > 1)
        .withColumn("run", run)
        .withColumn("slot", F.col("pos") % FAN)
        .withColumn("length", F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN))
    )
    window = Window.partitionBy("grp", "run").orderBy("pos")
    before = [F.when(F.col("slot") >= k, F.lag("node", k).over(window)) for k in range(1, FAN)]
    after = [
        F.when(F.col("slot") + k < F.col("length"), F.lead("node", k).over(window))
        for k in range(1, FAN)
    ]
    return placed.withColumns(
        {"left": F.concat_ws("", *reversed(before)), "right": F.concat_ws("", *after)}
    )


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The levels of the trees of all groups, from the given nodes up; the last has roots only."""
    levels = [nodes]
    while not levels[-1].where(F.col("n") > 1).isEmpty():
        parents = _siblings(levels[-1]).where("slot = 0")
        parents = parents.select(
            "grp",
            F.col("run").alias("pos"),
            F.call_function("div", F.col("n") + FAN - 1, F.lit(FAN)).alias("n"),
            digest(F.col("node"), F.col("right")).alias("node"),
        )
        levels.append(materialize(parents, f"level_{len(levels)}"))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """grp, node: the one node left of every group."""
    return reduce(
        DataFrame.unionByName, [level.where("n = 1").select("grp", "node") for level in levels]
    )


def _descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level with their paths, from the paths of the roots (grp, path).

    Further columns of ``above`` reach every node of their group, those of the lowest level too.
    """
    keyed = above.withColumn("run", F.lit(0).cast("long"))
    carried = [c for c in above.columns if c not in ("grp", "path")]
    one = F.struct("left", "right").cast("struct<left:string,right:string>")
    known = None  # grp, run: paths of the nodes of the level above, by their position
    for level in [*levels[:0:-1], levels[0]]:
        roots = level.where("n = 1").withColumn("run", F.lit(0).cast("long"))
        found = roots.join(keyed, ["grp", "run"])
        if known is not None:
            inner = _siblings(level).join(known, ["grp", "run"])
            inner = inner.withColumn("path", F.concat(F.array(one), "path"))
            found = found.unionByName(inner.drop("slot", "length", "left", "right"))
        if level is levels[0]:
            return found.drop("run", "pos", "n", "grp")
        known = materialize(
            found.select("grp", F.col("pos").alias("run"), "path", *carried), "paths"
        )
    raise AssertionError("a tree has a lowest level")


def manifest(rows: DataFrame) -> DataFrame:
    """All columns of ``rows`` with subroot, root and path: the siblings of the row up to the root.

    ``rows`` has doc_id, source and leaf, as ``leaves`` gives them. A path is an array with the
    digests left and right of the node on each level, concatenated; a source of one row adds no
    level, and a table of one row has an empty path. Null sources are a source of their own, the
    first; null ids come first in theirs. Rows equal in source, id and leaf stand side by side. An
    empty table has no rows. Columns grp, pos, n, node, run, slot, length, left, right, path,
    subroot, root and row_index of ``rows`` would clash and must not occur.
    """
    placed = with_row_index(materialize(rows, "leaves"), "source", "doc_id", "leaf")
    sources = placed.groupBy("source").agg(F.min("row_index").alias("first"), F.count("*").alias("n"))
    sources = materialize(with_row_index(sources, "source", name="grp"), "sources")
    # a source may hold a third of the rows; its row of the other side is broadcast or repeated
    nodes = join_skewed(placed, sources, "source", "row_index", "inner", null_safe=True)
    nodes = nodes.withColumn("pos", F.col("row_index") - F.col("first")).drop("first", "row_index")
    levels = _climb(nodes.withColumn("node", F.col("leaf")))

    subroots = materialize(_roots(levels), "subroots")
    n = subroots.count()
    tops = _climb(
        subroots.select(
            F.lit(0).cast("long").alias("grp"),
            (F.col("grp") - 1).alias("pos"),
            F.lit(n).cast("long").alias("n"),
            "node",
        ).withColumn("member", F.col("pos") + 1)
    )
    root = _roots(tops).select("node").first()
    ends = tops[0].sparkSession.range(1).select(
        F.col("id").alias("grp"), F.array().cast(_PATH).alias("path")
    )
    above = _descend(tops, ends).select(
        F.col("member").alias("grp"), F.col("node").alias("subroot"), "path"
    )
    whole = _descend(levels, materialize(above, "source_paths"))
    return whole.withColumn("root", F.lit(root["node"] if root else None).cast("string")).drop("node")
