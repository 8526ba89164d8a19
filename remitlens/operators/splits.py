"""Reproducible holdouts, folds, resamples and leak guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.values import hash_below, hash_bucket
from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import with_row_index
from remitlens.schemas import COMPANY, ID, LABEL, RECORD


def role(seed: int | Column, key: str, test_share: float) -> Column:
    """``test`` for about the given share of keys, else ``train``."""
    return F.when(hash_below(seed, F.col(key), test_share), "test").otherwise("train")


def repeated_roles(
    ids: DataFrame, key: str, runs: int, test_share: float, keep: Sequence[str] = ()
) -> DataFrame:
    """Every id with its role in each of ``runs`` holdouts."""
    runs_column = F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")
    spread = ids.select(key, *keep, runs_column)
    return spread.withColumn("role", role(F.col("run"), key, test_share))


def hash_fold(seed: int, key: str, k: int) -> Column:
    """Fold 1..k from the digest alone; needs no position and no join."""
    return (F.pmod(hash_bucket(seed, F.col(key)), F.lit(k)) + 1).cast("int")


def bootstrap(df: DataFrame, key: str, seed: int, draw_share: int) -> DataFrame:
    """Draw ``n / draw_share`` rows with replacement; ``draws`` is how often a row came up.

    Rows never drawn form the training side. The draws are made by the first rows of
    the index, each picking a position from its digest.
    """
    placed = with_row_index(df, key)
    n = placed.agg(F.max("row_index")).scalar()
    picked = (
        placed.filter(F.col("row_index") <= F.call_function("div", n, F.lit(draw_share)))
        .select((F.pmod(hash_bucket(seed, F.col("row_index")), n) + 1).alias("row_index"))
        .groupBy("row_index")
        .agg(F.count("*").alias("draws"))
    )
    return placed.join(picked, "row_index", "left").na.fill({"draws": 0})


def guard_leak(pay: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Payments without the labelled ones of test recipients.

    Only the few labelled payments look up their recipient; the others pass untouched.
    """
    labelled = F.coalesce(F.col(LABEL) == "Yes", F.lit(False))
    kept = join_skewed(pay.filter(labelled), test_ids.select(ID), ID, RECORD, "left_anti")
    return pay.filter(~labelled).unionByName(kept)


def lump_companies(pay: DataFrame, train: DataFrame, other: str = "Dummy") -> DataFrame:
    """Company kept where training payments carry the label, all others lumped."""
    label = (F.col(LABEL) == "Yes").cast("int")
    kept = (
        train.groupBy(COMPANY)
        .agg(F.sum(label).alias("_s"))
        .filter(F.col("_s") > 0)
        .select(COMPANY, F.col(COMPANY).cast("string").alias("company_level"))
    )
    joined = join_skewed(pay, kept, COMPANY, RECORD)
    return joined.na.fill({"company_level": other})
