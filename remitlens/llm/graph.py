"""Connected components by random hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges (a, b); one root per connected component.

    Each round every node hooks to the neighbour, or itself, that a fresh random order puts
    first, and edges are drawn between the heads; a constant share of the nodes vanishes, so the
    rounds grow with the logarithm of the longest path. All steps are grouped minima and
    joins, so a node with very many edges is no single task's load.
    """
    ends = edges.where(F.col("a") != F.col("b")).select("a", "b")
    ends = materialize(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    heads = None
    level = 0
    while not ends.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        hooks = materialize(
            ends.groupBy("a")
            .agg(F.least(F.min(order("b")), F.min(order("a"))).alias("m"))
            .select(F.col("a").alias("node"), F.col("m.v").alias("head")),
            "hooks",
        )
        if heads is None:
            heads = hooks.withColumnRenamed("head", "root")
        else:
            step = hooks.withColumnsRenamed({"node": "root", "head": "next"})
            heads = heads.join(step, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root")
            )
        heads = materialize(heads, "heads")
        left = hooks.withColumnsRenamed({"node": "a", "head": "p"})
        right = hooks.withColumnsRenamed({"node": "b", "head": "q"})
        ends = materialize(
            ends.join(left, "a")
            .join(right, "b")
            .where("p <> q")
            .select(F.col("p").alias("a"), F.col("q").alias("b"))
            .distinct(),
            "edges",
        )
        level += 1
    return heads if heads is not None else ends.select(F.col("a").alias("node"), F.col("b").alias("root"))
