"""The association tree against every division tried one by one."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from remitlens.models import association_tree as at
from remitlens.plans import binned_shares
from remitlens.schemas import ID

# The 0.95 and 0.99 points of the chi-square distribution.
POINTS = {1: (3.841459, 6.634897), 2: (5.991465, 9.210340), 5: (11.070498, 15.086272), 24: (36.415029, 42.979820)}


@pytest.mark.parametrize("df", POINTS)
def test_chance_of_known_points(df):
    for x, p in zip(POINTS[df], (0.05, 0.01)):
        assert math.exp(at.log_survival(x, df)) == pytest.approx(p, rel=1e-5)


def test_chance_far_out_and_at_zero():
    assert at.log_survival(0.0, 3) == 0.0
    assert at.log_survival(1e-300, 1) <= 0.0
    below, above = at.log_survival(1249.999999, 1), at.log_survival(1250.000001, 1)
    assert 0 < below - above < 1e-5  # both forms of the tail meet
    assert at.log_survival(20000.0, 2) == pytest.approx(-10000.0)


def pearson(a, n, all1, all_):
    """(n - 1) / n times Pearson's statistic of two classes over any number of groups."""
    total = 0.0
    for ai, ni in zip(a, n):
        for seen, share in ((ai, all1 / all_), (ni - ai, 1 - all1 / all_)):
            total += (seen - ni * share) ** 2 / (ni * share)
    return total * (all_ - 1) / all_


def grow(rows, features, ordered, min_split, min_leaf):
    """Nested (feature, left ids, right ids, ...) of the tree over rows (id, label, values)."""
    ids = sorted(r["id"] for r in rows)
    n, n1 = len(rows), sum(r["label"] for r in rows)
    if n < min_split or not 0 < n1 < n:
        return ids
    tests = []
    for place, f in enumerate(features):
        known = [r for r in rows if r[f] is not None]
        a1, a = sum(r["label"] for r in known), len(known)
        levels = sorted({r[f] for r in known})
        if not 0 < a1 < a or len(levels) < 2:
            continue
        of = {v: [r["label"] for r in known if r[f] == v] for v in levels}
        if f in ordered:
            mx, my = sum(r[f] for r in known) / a, a1 / a
            xy = sum((r[f] - mx) * (r["label"] - my) for r in known)
            xx = sum((r[f] - mx) ** 2 for r in known)
            chi2, df = (a - 1) * xy**2 / (xx * a * my * (1 - my)), 1
            sides = [levels[:i] for i in range(1, len(levels))]
        else:
            chi2 = pearson([sum(of[v]) for v in levels], [len(of[v]) for v in levels], a1, a)
            df = len(levels) - 1
            sides = [c for k in range(1, len(levels)) for c in combinations(levels, k)]
        fair = []
        for side in sides:
            inside = [y for v in side for y in of[v]]
            if min_leaf <= len(inside) <= a - min_leaf:
                # the left side is the one of the lesser share
                if f in ordered or sum(inside) / len(inside) < a1 / a:
                    both = ([sum(inside), a1 - sum(inside)], [len(inside), a - len(inside)])
                    fair.append((round(pearson(*both, a1, a), 9), set(side)))
        log_p = round(at.log_survival(chi2, df), 9)
        if fair and (1 - math.exp(log_p)) ** len(features) > 0.95:
            best = max(f[0] for f in fair)
            tests.append((log_p, -round(chi2, 9), place, f, a, [s for d, s in fair if d == best]))
    if not tests:
        return ids
    _, _, _, f, a, best = min(tests, key=lambda t: t[:3])
    assert len(best) == 1  # the table has no ties among divisions
    n_left = sum(r[f] in best[0] for r in rows)
    larger = 2 * n_left >= a
    left = [r for r in rows if (r[f] in best[0] if r[f] is not None else larger)]
    right = [r for r in rows if r not in left]
    return (f, *[grow(side, features, ordered, min_split, min_leaf) for side in (left, right)])


def shape(tree, placed, node=0):
    at_node = next(x for x in tree.nodes if x.node == node)
    if at_node.feature is None:
        return sorted(i for i, leaf in placed if leaf == node)
    return (at_node.feature, shape(tree, placed, at_node.left), shape(tree, placed, at_node.right))


FEATURES, ORDERED = ("a", "b", "c", "size"), ("size",)


@pytest.fixture(scope="module")
def table(spark):
    def drawn(i, salt, k):
        return (i * 2654435761 + salt * 40503 + i * i * salt) % 1009 % k

    rows = []
    for i in range(420):
        a, b, c, size = drawn(i, 1, 5), drawn(i, 2, 4), drawn(i, 3, 7), drawn(i, 4, 9)
        odds = (a in (1, 3)) * 55 + (b == 2) * 25 * (a in (1, 3)) + 30 * (a == 4) * (size > 4)
        label = int(drawn(i, 5, 100) < odds + 5)
        b = None if drawn(i, 6, 11) == 0 else f"b{b}"
        rows.append({"id": i, "label": label, "a": f"a{a}", "b": b, "c": f"c{c}", "size": size})
    kinds = "id int, label int, a string, b string, c string, size int"
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], kinds)


@pytest.mark.parametrize("min_leaf", [7, 40])
def test_tree_of_every_division_tried(table, min_leaf):
    rows, df = table
    tree = at.fit(df, "label", FEATURES, ORDERED, min_leaf=min_leaf)
    placed = [tuple(r) for r in tree.score(df, ["id"]).select("id", "node").collect()]
    want = grow(rows, FEATURES, ORDERED, at.MIN_SPLIT, min_leaf)
    assert shape(tree, placed) == want
    assert len(tree.nodes) >= 5
    for x in tree.nodes:
        inside = [i for i, leaf in placed if leaf == x.node]
        if x.feature is None:
            assert (x.n, x.n1) == (len(inside), sum(rows[i]["label"] for i in inside))


def test_tree_without_broadcasts(table, no_broadcast):
    rows, df = table
    tree = at.fit(df, "label", FEATURES, ORDERED)
    placed = [tuple(r) for r in tree.score(df, ["id"]).select("id", "node").collect()]
    assert shape(tree, placed) == grow(rows, FEATURES, ORDERED, at.MIN_SPLIT, at.MIN_LEAF)


def test_levels_one_and_three_against_two(spark):
    """A set of levels that no cut along their index gives."""
    rows = spark.range(300).select(
        "id", (F.col("id") % 3 + 1).alias("v"), F.lit("x").alias("same"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.when(F.col("id") % 50 == 0, 1).otherwise(0)).alias("label"),
    )
    tree = at.fit(rows, "label", ("v", "same"))
    routes = tree.steps[0][1]
    sides = {r.level: r.child for r in routes.filter("node = 0").collect()}
    assert sides["1"] == sides["3"] != sides["2"]


def test_unseen_and_null_levels_follow_the_larger_side(spark, table):
    _, df = table
    tree = at.fit(df, "label", FEATURES, ORDERED, max_depth=1)
    root = tree.nodes[0]
    larger = max(tree.nodes[1:], key=lambda x: x.n).node
    odd = spark.createDataFrame([("new", None, "new", None), (None,) * 4], "a string, b string, c string, size int")
    assert root.feature and {r.node for r in tree.score(odd, ["a"]).collect()} == {larger}


def test_tables_that_give_one_leaf(spark):
    kinds = "label int, a string"
    for lines in ([], [(None, "x")] * 30, [(1, "x")] * 30, [(1, "x"), (0, "y")] * 5, [(1, None), (0, None)] * 20):
        rows = spark.createDataFrame(lines, kinds)
        tree = at.fit(rows, "label", ("a",))
        assert len(tree.nodes) == 1 and not tree.steps
        assert tree.score(rows, ["a"]).count() == len(lines)


def test_rows_of_recipients(tables):
    found = binned_shares.share_rows(tables.phys, tables.pay, tables.comp)
    one = found.filter("company_bin is not null").groupBy("id", "Company_ID").agg(
        F.countDistinct("company_bin").alias("bins")
    )
    assert one.filter("bins <> 1").count() == 0
    assert found.join(tables.phys.filter("Primary_Specialty is null"), "id").count() == 0
    assert found.select("id").distinct().join(tables.pay, found.id == F.col(ID)).count() > 0
