"""Association of categorical features with the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.models.bayes import ALL, CLASSES, count_levels
from remitlens.operators.joins import join_skewed
from remitlens.session import materialize


def chi_square(rows: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Pearson statistic and degrees of freedom per feature.

    The rows are reduced to level counts first, which are written, so that the margins (one row
    per feature) are known to be small. They are aggregates joined back.
    """
    counts = count_levels(rows, label, features).filter(F.col("feature") != ALL)
    per_level = counts.groupBy("feature", "value").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in CLASSES]
    )
    per_level = materialize(per_level, "level_counts")
    whole = per_level.groupBy("feature").agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    margins = join_skewed(per_level, whole, "feature", "value", "inner").drop("value")
    level = (F.col("n0") + F.col("n1")).cast("double")
    total = F.col("all0") + F.col("all1")

    def term(n: str, margin: str):
        expected = level * F.col(margin) / total
        gap = F.col(n) - expected
        return F.try_divide(gap * gap, expected)

    statistic = F.sum(
        F.coalesce(term("n0", "all0"), F.lit(0.0)) + F.coalesce(term("n1", "all1"), F.lit(0.0))
    )
    used_classes = F.max((F.col("all0") > 0).cast("int") + (F.col("all1") > 0).cast("int"))
    return margins.groupBy("feature").agg(
        statistic.alias("chi2"), ((F.count("*") - 1) * (used_classes - 1)).alias("df")
    )


def chi_square_p_values(vectors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """P-values of the features of assembled vectors, named by their dictionary."""
    tests = ChiSquareTest.test(vectors, "features", "label", flatten=True)
    return tests.join(dictionary, tests.featureIndex == dictionary.idx).select(
        "feature", "pValue", "statistic", F.col("degreesOfFreedom").alias("df")
    )
