"""Medians from merged quantile sketches."""

import pytest
from pyspark.sql import functions as F

from remitlens.operators.aggregates import amount_sketches, merged_sketches, sketched_median


def amounts(spark, n):
    value = (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 100).cast("decimal(18,2)")
    return spark.range(0, n, 1, 8).select("id", (F.col("id") % 3).alias("k"), value.alias("v"))


def test_rank_error_after_merging_batches(spark):
    df = amounts(spark, 90_000)
    parts = [amount_sketches(df.filter(F.col("id") % 5 == i), "k", "v") for i in range(5)]
    stored = parts[0]
    for part in parts[1:]:
        stored = stored.unionByName(part)
    found = sketched_median(merged_sketches(stored, "k"), "k", "m")
    below = F.avg((F.col("v") <= F.col("m")).cast("double"))
    ranks = [r[1] for r in df.join(found, "k").groupBy("k").agg(below).collect()]
    assert len(ranks) == 3 and all(abs(r - 0.5) < 0.04 for r in ranks)


def test_small_groups_nulls_and_no_rows(spark):
    lines = [(1, "3.10"), (1, "1.05"), (1, "2.00"), (1, "9.99"), (2, None), (None, "7.00")]
    df = spark.createDataFrame(lines, "k int, v string").withColumn("v", F.col("v").cast("decimal(9,2)"))
    found = sketched_median(merged_sketches(amount_sketches(df, "k", "v"), "k"), "k")
    assert {tuple(r) for r in found.collect()} == {(1, 2.0), (None, 7.0)}
    assert sketched_median(amount_sketches(df.limit(0), "k", "v"), "k").count() == 0
    with pytest.raises(TypeError):
        amount_sketches(df.withColumn("v", F.lit("x")), "k", "v")
