"""One key holding a third of the rows: salted joins and spread medians stay exact."""

import pytest
from pyspark.sql import functions as F

from remitlens.models import bayes
from remitlens.operators.aggregates import attach_totals, exact_median
from remitlens.operators import joins
from remitlens.operators.joins import hot_keys, join_keeping_dimension, join_skewed
from remitlens.plans import jobs
from remitlens.plans.clean import BAYES_FEATURES, bayes_rows
from remitlens.schemas import RECORD
from tests.conftest import rows

N = 6000


@pytest.fixture(autouse=True)
def small_tasks(monkeypatch):
    """A key of a third of the rows is hot, whatever the number of partitions."""
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 700)


@pytest.fixture(scope="module")
def fact(spark):
    """A third of the rows on key 0, some on null, the rest on many keys."""
    key = (
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 10 == 1, None)
        .otherwise(F.col("id") % 500 + 1)
    )
    amount = ((F.col("id") * 7919) % 100003 / 100 - 100).cast("decimal(18,2)")
    return spark.range(N).select(F.col("id").alias("row"), key.alias("k"), amount.alias("amount"))


@pytest.fixture(scope="module")
def dim(spark):
    return spark.range(0, 520, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))


def test_hot_keys_are_few_and_salted_by_rows(fact):
    found = {r.k: r._salts for r in hot_keys(fact, ["k"]).collect()}
    assert found == {0: 3}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain(fact, dim, how):
    plain = fact.join(dim, "k", how)
    salted = join_skewed(fact, dim, "k", "row", how, salted=True)
    assert salted.columns == plain.columns
    assert rows(salted, "row") == rows(plain, "row")


def test_dimension_rows_without_fact_survive(fact, dim):
    got = join_keeping_dimension(dim, fact, "k", "row")
    plain = dim.join(fact, "k", "left").select(got.columns)
    order = ["k", "row"]
    assert rows(got, *order) == rows(plain, *order)


def test_totals_reach_every_row(fact, no_broadcast):
    got = attach_totals(fact, ["k"], "row", total=F.sum("amount"))
    plain = fact.withColumn("total", F.expr("sum(amount) over (partition by k)"))
    assert rows(got.select("row", "total"), "row") == rows(plain.select("row", "total"), "row")


@pytest.mark.parametrize("scale", [0, 2, 3])
def test_median_is_exact_for_hot_and_null_keys(fact, scale):
    base = fact.withColumn("amount", (F.col("amount") * 1.003).cast(f"decimal(16,{scale})"))
    plain = base.groupBy("k").agg(F.median(F.col("amount").cast("double")).alias("m"))
    got = exact_median(base, "k", "amount", "m")
    expected = dict(rows(plain, "k"))
    found = dict(rows(got, "k"))
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], abs=1e-9) for k in expected)


def test_salted_scoring_equals_joined_scoring(spark, tables):
    base = bayes_rows(tables.phys, tables.pay, tables.comp).cache()
    model = jobs.fit_bayes(base)
    joined = rows(jobs.score_bayes(base, model).select(RECORD, "log_0", "log_1", "prediction"), RECORD)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        scored = jobs.score_bayes(base, model)
        long = rows(scored.select(RECORD, "log_0", "log_1", "prediction"), RECORD)
    finally:
        spark.conf.set(key, before)
        base.unpersist()
    assert len(long) == len(joined) > 0
    for a, b in zip(long, joined):
        assert a[0] == b[0] and a[3] == b[3]
        assert a[1:3] == pytest.approx(b[1:3], abs=1e-9)


def test_repeated_row_keys_are_scored_row_by_row(spark, no_broadcast):
    train = spark.createDataFrame(
        [("a", 0), ("a", 0), ("b", 1), ("b", 1), ("a", 1)], "f string, y int"
    )
    model = bayes.fit(train, "y", ["f"])
    one = spark.createDataFrame([(0, "a"), (1, "b")], "row int, f string")
    same = spark.createDataFrame([(7, "a"), (7, "b"), (7, "b")], "row int, f string")
    known = dict(rows(bayes.predict(one, model).select("f", "log_1"), "f"))
    got = rows(bayes.predict(same, model).select("f", "log_1"), "f")
    assert len(got) == 3
    assert all(log == pytest.approx(known[f]) for f, log in got)


def test_one_fold_table_scores_every_fold_with_its_own_model(spark, monkeypatch):
    lines = [(i, "ab"[i % 3 == 0], "xyz"[i % 5 % 3], int(i % 3 == 0) ^ int(i % 7 == 0), i % 4 + 1) for i in range(80)]
    data = spark.createDataFrame(lines, "row int, f string, g string, y int, fold int")
    counts = bayes.count_levels(data, "y", ["f", "g"], "fold")
    folds = bayes.fit_folds(counts, ["f", "g"], "fold", 4)
    names = ["row", "log_0", "log_1", "prediction"]
    got = rows(bayes.predict(data, folds).select(*names), "row")
    for fold in range(1, 5):
        alone = bayes.fit(data.filter(F.col("fold") != fold), "y", ["f", "g"])
        for r in bayes.predict(data.filter(F.col("fold") == fold), alone).select(*names).collect():
            assert got[r.row][1:3] == pytest.approx((r.log_0, r.log_1)) and got[r.row][3] == r.prediction
    monkeypatch.setattr(bayes, "MAP_LEVELS", 1)  # now by the join
    assert rows(bayes.predict(data, folds).select(*names), "row") == got


@pytest.mark.parametrize("limit", [200, 0])
def test_missing_and_unknown_values_are_skipped(spark, monkeypatch, limit):
    monkeypatch.setattr(bayes, "MAP_LEVELS", limit)
    train = spark.createDataFrame(
        [(0, "a", 0), (1, "a", 0), (2, "b", 1), (3, "b", 1)], "row int, f string, y int"
    )
    model = bayes.fit(train, "y", ["f"])
    test = spark.createDataFrame([(0, None), (1, "zzz"), (2, "b")], "row int, f string")
    got = rows(bayes.predict(test, model).select("row", "log_0", "log_1", "prediction"), "row")
    assert got[0][1:] == got[1][1:]  # only the prior is left
    assert got[2][3] == 1


def test_complete_marks_rows_without_gaps(tables):
    got = bayes_rows(tables.phys, tables.pay, tables.comp)
    kept = got.filter("complete").count()
    assert 0 < kept < got.count()
    assert got.dropna("any", subset=["label", *BAYES_FEATURES]).count() == kept
    assert got.filter("complete").dropna("any", subset=["label", *BAYES_FEATURES]).count() == kept
