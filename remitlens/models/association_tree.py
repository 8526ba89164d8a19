"""A classification tree that divides a node only where a feature is associated with the label.

Every node tests each feature by the chi-square form of the permutation statistic ((n - 1) / n times
Pearson's; (n - 1) r^2 for ordered features), corrected for the number of features. The feature of
least p-value divides the node into two sets of levels, chosen by the same statistic. Rows are first
reduced to their distinct feature values with counts; one pass over those grows a whole tree level.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.operators.joins import join_skewed
from remitlens.session import materialize

# Settings of the known run.
MIN_CRITERION = 0.95
MIN_SPLIT = 20
MIN_LEAF = 7
#: The known run sets no depth; this bounds the nodes the driver lists.
MAX_DEPTH = 12
_DIGITS = 9  # statistics are compared to so many places, so that sums in any order choose alike


@dataclass(frozen=True)
class Node:
    node: int
    depth: int
    n: int
    n1: int
    feature: str | None = None
    chi2: float | None = None
    df: int | None = None
    log_p: float | None = None
    left: int | None = None
    right: int | None = None


@dataclass(frozen=True)
class AssociationTree:
    """``steps`` holds, per depth, the divided nodes and the table (node, level, child)."""

    features: tuple[str, ...]
    nodes: tuple[Node, ...]
    steps: tuple[tuple[DataFrame, DataFrame], ...]

    def table(self, spark) -> DataFrame:
        kinds = "node int, depth int, n bigint, n1 bigint, feature string, chi2 double, df int, "
        kinds += "log_p double, left int, right int"
        rows = [tuple(vars(x).values()) for x in self.nodes]
        return materialize(spark.createDataFrame(rows, kinds), "nodes")

    def score(self, rows: DataFrame, spread_by: Sequence[str], threshold: float = 0.5) -> DataFrame:
        """Keeps all columns; adds the leaf, its share of label 1 and the cut prediction."""
        placed = rows.withColumn("node", F.lit(0))
        for divided, routes in self.steps:
            placed = _descend(placed, divided, routes, self.features, spread_by, "left")
        leaves = self.table(rows.sparkSession).filter("feature is null")
        share = F.try_divide(F.col("n1").cast("double"), F.col("n").cast("double"))
        leaves = leaves.select("node", F.coalesce(share, F.lit(0.0)).alias("score"))
        scored = join_skewed(placed, leaves, "node", spread_by)
        return scored.withColumn("prediction", (F.col("score") > threshold).cast("int")).select(
            *rows.columns, "node", "score", "prediction"
        )


def log_survival(x: float, df: int) -> float:
    """Log of the chance that a chi-square value of ``df`` degrees of freedom exceeds ``x``.

    The closed sums for whole degrees of freedom, added up as logs: no underflow.
    """
    if x <= 0:
        return 0.0
    h = x / 2
    if df % 2:
        z = math.sqrt(h)
        if z < 25:
            logs = [math.log(math.erfc(z))]
        else:  # the first terms of the tail series give ten digits there
            series = math.log1p(-0.5 / h + 0.75 / h**2 - 1.875 / h**3)
            logs = [series - math.log(z * math.sqrt(math.pi)) - h]
        logs += [(k - 0.5) * math.log(h) - math.lgamma(k + 0.5) - h for k in range(1, df // 2 + 1)]
    else:
        logs = [k * math.log(h) - math.lgamma(k + 1) - h for k in range(df // 2)]
    most = max(logs)
    return min(0.0, most + math.log(math.fsum(math.exp(v - most) for v in logs)))


def significant(log_p: float, tests: int, criterion: float) -> bool:
    """Whether one of ``tests`` features passes after the Bonferroni correction."""
    p = math.exp(log_p)
    return p < 1 and tests * math.log1p(-p) > math.log(criterion)


def collapse(rows: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Distinct feature values with their rows and rows of label 1; unlabelled rows are left out."""
    known = rows.filter(F.col(label).isNotNull())
    return known.groupBy(*[F.col(f).cast("string").alias(f) for f in features]).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("n1")
    )


def graded_levels(
    cells: DataFrame, features: Sequence[str], ordered: Sequence[str] = ()
) -> DataFrame:
    """Levels of every (node, feature) in dividing order, with running and whole counts.

    Nominal levels go by their share of label 1: with two classes the best of all divisions into
    two sets is a cut in that order. Ordered ones go by value. Null is no level. A window holds
    the levels of one feature, never rows.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in features])
    levels = (
        cells.select("node", "n", "n1", F.inline(pairs))
        .filter(F.col("level").isNotNull())
        .groupBy("node", "feature", "level")
        .agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    )
    share = F.col("n1").cast("double") / F.col("n")
    at = F.when(F.col("feature").isin(list(ordered)), F.col("level").try_cast("double"))
    levels = levels.withColumn("at", at if ordered else F.lit(None).cast("double"))
    whole = Window.partitionBy("node", "feature")
    order = whole.orderBy(F.coalesce("at", share), "level")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return levels.select(
        "*",
        F.row_number().over(order).alias("rank"),
        F.sum("n").over(running).alias("n_left"),
        F.sum("n1").over(running).alias("n1_left"),
        F.count("*").over(whole).alias("k"),
        F.sum("n").over(whole).alias("all"),
        F.sum("n1").over(whole).alias("all1"),
    )


def split_tests(graded: DataFrame, min_leaf: int = MIN_LEAF) -> DataFrame:
    """Per (node, feature): statistic, degrees of freedom, best division and the rows on its left.

    ``cut`` is null where no division leaves ``min_leaf`` rows on both sides.
    """
    n, n1, all_, all1, left, left1 = (
        F.col(c).cast("double") for c in ("n", "n1", "all", "all1", "n_left", "n1_left")
    )
    rest = all_ - left
    scale = (all_ - 1) * all_ / (all1 * (all_ - all1))
    gap, gap_left = n1 - n * all1 / all_, left1 - left * all1 / all_
    both = graded.filter("all1 > 0 and all1 < all and k > 1")
    mean = F.sum(n * F.col("at")).over(Window.partitionBy("node", "feature")) / all_
    terms = both.select(
        "node", "feature", "k", "rank", "n_left", "all",
        F.col("at").isNotNull().alias("is_ordered"),
        scale.alias("scale"),
        (gap * gap / n).alias("nominal"),
        (gap * (F.col("at") - mean)).alias("xy"),
        (n * (F.col("at") - mean) ** 2).alias("xx"),
        F.when(
            (left >= min_leaf) & (rest >= min_leaf),
            F.round(scale * gap_left * gap_left * all_ / (left * rest), _DIGITS),
        ).alias("division"),
    )
    by_value = F.try_divide(F.sum("xy") * F.sum("xy"), F.sum("xx")) * F.max("scale")
    chi2 = F.when(F.max("is_ordered"), by_value).otherwise(F.sum("nominal") * F.max("scale"))
    rank = F.when(F.col("division").isNotNull(), F.struct("division", -F.col("rank")))
    best = F.max_by(F.struct("rank", "division", "n_left"), rank)
    return (
        terms.groupBy("node", "feature")
        .agg(
            F.round(chi2, _DIGITS).alias("chi2"),
            F.when(F.max("is_ordered"), 1).otherwise(F.max("k") - 1).cast("int").alias("df"),
            F.max("all").alias("n_known"),
            best.alias("_b"),
        )
        .select(
            "node", "feature", "chi2", "df", "n_known",
            F.col("_b.rank").alias("cut"),
            F.col("_b.division").alias("division"),
            F.when(F.col("_b").isNotNull(), F.col("_b.n_left")).alias("n_left"),
        )
    )


def _value_of(features: Sequence[str], name: Column) -> Column:
    return F.coalesce(*[F.when(name == f, F.col(f).cast("string")) for f in features])


def _descend(
    rows: DataFrame,
    divided: DataFrame,
    routes: DataFrame,
    features: Sequence[str],
    spread_by: Sequence[str],
    how: str,
) -> DataFrame:
    """Rows moved to the children of their node; null and unknown levels go to the larger child.

    Rows of nodes that are not divided stay with ``how`` left and leave with inner.
    """
    kept = [c for c in rows.columns if c != "node"]
    at_node = join_skewed(rows, divided, "node", spread_by, how)
    at_node = at_node.withColumn("level", _value_of(features, F.col("_feature")))
    moved = join_skewed(at_node, routes, ["node", "level"], spread_by)
    return moved.select(*kept, F.coalesce("child", "_default", "node").alias("node"))


def fit(
    rows: DataFrame,
    label: str,
    features: Sequence[str],
    ordered: Sequence[str] = (),
    criterion: float = MIN_CRITERION,
    min_split: int = MIN_SPLIT,
    min_leaf: int = MIN_LEAF,
    max_depth: int = MAX_DEPTH,
) -> AssociationTree:
    """Grow level by level until no open node has a significant feature that can divide it.

    The driver gets one row per open node and feature, at most ``2 ** max_depth`` nodes; levels
    and their routes stay tables. Without labelled rows the tree is one empty leaf.
    """
    spark = rows.sparkSession
    features = tuple(features)
    cells = materialize(collapse(rows, label, features).withColumn("node", F.lit(0)), "cells")
    n, n1 = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    nodes = {0: Node(0, 0, n, n1)}
    open_nodes, steps = [0], []
    for depth in range(max_depth):
        if not any(nodes[i].n >= min_split and 0 < nodes[i].n1 < nodes[i].n for i in open_nodes):
            break
        graded = materialize(graded_levels(cells, features, ordered), "levels")
        chosen = _choose(
            split_tests(graded, min_leaf).collect(), nodes, features, criterion, min_split
        )
        if not chosen:
            break
        lines = []
        for test, log_p in chosen:
            left, right = len(nodes), len(nodes) + 1
            at = nodes[test.node]
            nodes[test.node] = Node(
                at.node, depth, at.n, at.n1, test.feature, test.chi2, test.df, log_p, left, right
            )
            larger = left if 2 * test.n_left >= test.n_known else right
            lines.append((test.node, test.feature, test.cut, left, right, larger))
            nodes[left], nodes[right] = (Node(i, depth + 1, 0, 0) for i in (left, right))
        names = "node int, _feature string, cut int, left int, right int, _default int"
        picked = materialize(spark.createDataFrame(lines, names), "picked")
        routes = graded.join(picked, "node").filter("feature = _feature")
        child = F.when(F.col("rank") <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
        routes = materialize(routes.select("node", "level", child.alias("child")), "routes")
        divided = picked.select("node", "_feature", "_default")
        steps.append((divided, routes))
        moved = _descend(cells, divided, routes, features, features, "inner")
        cells = materialize(moved, "cells")
        open_nodes = []
        for r in cells.groupBy("node").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).collect():
            nodes[r.node] = Node(r.node, depth + 1, r.n, r.n1)
            open_nodes.append(r.node)
    return AssociationTree(features, tuple(nodes[i] for i in sorted(nodes)), tuple(steps))


def _choose(tests, nodes, features, criterion: float, min_split: int):
    """The dividing test of every node that has one, with the log of its p-value, in node order."""
    best = {}
    for t in tests:
        if t.cut is None or t.chi2 is None or nodes[t.node].n < min_split:
            continue
        log_p = round(log_survival(t.chi2, t.df), _DIGITS)
        if significant(log_p, len(features), criterion):
            key = (log_p, -t.chi2, features.index(t.feature))
            if t.node not in best or key < best[t.node][0]:
                best[t.node] = (key, t)
    return [(best[i][1], best[i][0][0]) for i in sorted(best)]
