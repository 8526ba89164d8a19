"""Confusion counts and balanced accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.values import any_known


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def confusion(
    scored: DataFrame,
    *by: str,
    truth: str = "truth",
    prediction: str = "prediction",
    weight: str | None = None,
):
    """tp, fp, fn, tn per group; a class that never occurs counts 0.

    With ``weight`` a row counts so many times, as if it were repeated.
    """
    t, p = F.col(truth), F.col(prediction)

    def cell(test: Column) -> Column:
        if weight is None:
            return _count(test)
        return F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0))

    return scored.groupBy(*by).agg(
        cell((t == 1) & (p == 1)).alias("tp"),
        cell((t == 0) & (p == 1)).alias("fp"),
        cell((t == 1) & (p == 0)).alias("fn"),
        cell((t == 0) & (p == 0)).alias("tn"),
    )


def balanced_accuracy(counts: DataFrame) -> DataFrame:
    """Adds sensitivity, specificity and their mean; null where a class is absent."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return counts.withColumns(
        {"sensitivity": sens, "specificity": spec, "bac": (sens + spec) / 2}
    )


def evaluate(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    return balanced_accuracy(confusion(scored, *by, weight=weight))


def roll_up(scored: DataFrame, key: str, *by: str) -> DataFrame:
    """Transaction predictions and truths to one row per key, by three-valued any."""
    return scored.groupBy(key, *by).agg(
        any_known(F.col("prediction")).alias("prediction"),
        any_known(F.col("truth")).alias("truth"),
    )


def sweep(scored: DataFrame, thresholds: Sequence[float], score: str = "score") -> DataFrame:
    """Metrics of every cut-off over one set of scores."""
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    cut = scored.select("truth", score, cuts)
    return evaluate(
        cut.withColumn("prediction", (F.col(score) > F.col("threshold")).cast("int")), "threshold"
    )


def best_run(metrics: DataFrame, *keep: str) -> DataFrame:
    """The run with the highest BAC; the earliest of equals."""
    rank = F.struct(F.col("bac"), -F.col("run"))
    best = F.max_by(F.struct("run", "bac", *keep), rank)
    return metrics.filter(F.col("bac").isNotNull()).agg(best.alias("_b")).select("_b.*")
