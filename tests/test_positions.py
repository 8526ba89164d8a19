"""Binding by position, numbers of levels, weighted confusion, out-of-fold company levels."""

import pytest
from pyspark.sql import functions as F

from remitlens.models.evaluate import confusion
from remitlens.operators.ordering import bind_by_position, number_levels
from remitlens.plans.attribute_counts import company_counts, out_of_fold_sums
from tests.conftest import rows


def test_rows_of_equal_rank_meet(spark):
    left = spark.range(0, 5000, 1, 7).select((F.col("id") * 3 % 5000).alias("a"))
    right = spark.range(5000).select((-F.col("id")).alias("b"), F.col("id").alias("score"))
    bound = bind_by_position(left, right, ["a"], ["b"])
    assert bound.count() == 5000
    assert bound.filter(F.col("a") - F.col("b") != 4999).count() == 0


def test_other_lengths_and_names_are_errors(spark):
    with pytest.raises(ValueError, match="3 rows can't be bound to 4"):
        bind_by_position(spark.range(3).toDF("a"), spark.range(4).toDF("b"), ["a"], ["b"])
    with pytest.raises(ValueError, match="both frames"):
        bind_by_position(spark.range(3).toDF("a"), spark.range(3).toDF("a"), ["a"], ["a"])


def test_empty_frames_bind(spark):
    none = spark.range(0)
    assert bind_by_position(none.toDF("a"), none.toDF("b"), ["a"], ["b"]).columns == ["a", "b"]


def test_levels_are_numbered_per_column(spark):
    lines = [("x", "b"), ("y", "k"), ("x", "a"), ("x", "b"), ("x", None), ("y", ""), ("z", None)]
    found = number_levels(spark.createDataFrame(lines, "column_name string, level string"))
    assert rows(found, "column_name", "idx") == [("x", "a", 1), ("x", "b", 2), ("y", "", 1), ("y", "k", 2)]


def test_weights_count_like_repeated_rows(spark):
    lines = [(i, i % 2, i % 3 % 2, i % 4) for i in range(60)]
    scored = spark.createDataFrame(lines, "id int, truth int, prediction int, w int")
    repeated = scored.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("w"))))
    assert confusion(scored, weight="w").collect() == confusion(repeated).collect()
    assert tuple(confusion(scored.limit(0), weight="w").first()) == (0, 0, 0, 0)


def test_labels_of_a_fold_never_decide_its_levels(spark):
    # company 1: label in fold 1 only; company 2: in both; company 3: nowhere; one without company
    cells = spark.createDataFrame(
        [(10, 1, 4, 2), (20, 1, 1, 0), (10, 2, 1, 1), (20, 2, 1, 1), (20, 3, 2, 0), (10, None, 1, 1)],
        "id long, Company_ID long, n long, positives long",
    )
    folds = spark.createDataFrame([(10, 1), (20, 2)], "id long, fold int")
    sums = out_of_fold_sums(cells, folds, 2)
    assert rows(sums, "Company_ID", "fold") == [
        (1, 1, 2, 0, "Dummy"), (1, 2, 0, 2, "1"), (2, 1, 1, 1, "2"), (2, 2, 1, 1, "2"),
        (3, 1, 0, 0, "Dummy"), (3, 2, 0, 0, "Dummy"),
    ]
    assert rows(company_counts(cells, sums, 1), "id", "feature") == [
        (10, "COMP_ 2", 1.0), (10, "COMP_ Dummy", 5.0), (20, "COMP_ 2", 1.0), (20, "COMP_ Dummy", 3.0),
    ]


def test_levels_follow_the_training_side_alone(spark):
    """Against each fold done by itself."""
    cells = spark.range(600).select(
        (F.col("id") % 97).alias("id"), (F.xxhash64("id") % 23).alias("Company_ID"),
        F.lit(1).alias("n"), (F.xxhash64("id", F.lit(1)) % 9 == 0).cast("long").alias("positives"),
    )
    folds = spark.range(97).select("id", (F.col("id") % 4 + 1).cast("int").alias("fold"))
    got = {(r.Company_ID, r.fold): r.level for r in out_of_fold_sums(cells, folds, 4).collect()}
    for fold in range(1, 5):
        train = cells.join(folds.filter(F.col("fold") != fold), "id")
        kept = {r[0] for r in train.filter("positives > 0").select("Company_ID").distinct().collect()}
        assert {c for (c, f), level in got.items() if f == fold and level != "Dummy"} == kept
