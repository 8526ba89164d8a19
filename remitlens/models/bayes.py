"""Categorical Naive Bayes as counts, ratios and joins.

Classes are 0 and 1. Counting is one aggregation over all features. Scoring looks the values of a
row up in one table of maps while the model is small, so the scored rows are not shuffled, and
meets a larger model by one salted join in long form. Both give each row its own sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.operators.joins import join_skewed
from remitlens.session import fits_broadcast, materialize

CLASSES = (0, 1)
#: Levels of one feature up to which rows look through a map of them.
MAP_LEVELS = 200

ALL = ""  # pseudo feature whose single level counts the rows of a class


@dataclass(frozen=True)
class NaiveBayes:
    """``logs`` is the fitted model: log probabilities of both classes per level.

    Its rows of the pseudo feature hold the priors. ``ratios`` shows the counts and
    probabilities behind them, one column per class.
    """

    features: tuple[str, ...]
    logs: DataFrame  # [by...], feature, value, log_0, log_1
    ratios: DataFrame  # [by...], feature, value, n_levels, n_c, n_class_c, p_c
    by: tuple[str, ...] = ()

    def conditionals(self) -> DataFrame:
        """One row per class and level."""
        rows = self.ratios.filter(F.col("feature") != ALL)
        return self._per_class(rows, "n", "n_class", "p").drop("n_all")

    def priors(self) -> DataFrame:
        """One row per class found in training."""
        rows = self.ratios.filter(F.col("feature") == ALL).drop("feature", "value")
        found = self._per_class(rows, "n", "p").filter(F.col("n") > 0)
        return found.select(*self.by, "class", "n", F.col("p").alias("prior"))

    def _per_class(self, rows: DataFrame, *names: str) -> DataFrame:
        kept = [c for c in rows.columns if not c.endswith(tuple(f"_{k}" for k in CLASSES))]
        entries = [
            F.struct(F.lit(c).alias("class"), *[F.col(f"{n}_{c}").alias(n) for n in names])
            for c in CLASSES
        ]
        return rows.select(*kept, F.inline(F.array(*entries)))


def feature_values(features: Sequence[str], *extra: Column) -> Column:
    """Array of (feature, value) structs of a row."""
    return F.array(*[_pair(F.lit(f), F.col(f).cast("string")) for f in features], *extra)


def _pair(feature: Column, value: Column) -> Column:
    return F.struct(feature.alias("feature"), value.alias("value"))


def count_levels(rows: DataFrame, label: str, features: Sequence[str], *by: str) -> DataFrame:
    """Rows per class, feature and level, and per class under the pseudo feature.

    Unlabelled rows count under a null class, so their levels are known too.
    """
    everything = _pair(F.lit(ALL), F.lit(ALL))
    return (
        rows.select(
            *by, F.col(label).alias("class"), F.inline(feature_values(features, everything))
        )
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "class", "feature", "value")
        .agg(F.count("*").alias("n"))
    )


def _model(
    features: Sequence[str],
    counts: DataFrame,
    used: Column,
    by: Sequence[str],
    smooth: float,
    prior_smooth: float,
) -> NaiveBayes:
    """Model from level counts; counts outside ``used`` only contribute their levels."""
    n = {
        c: F.sum(F.when(used & (F.col("class") == c), F.col("n")).otherwise(0)) for c in CLASSES
    }
    wide = counts.groupBy(*by, "feature", "value").agg(
        *[n[c].cast("bigint").alias(f"n_{c}") for c in CLASSES]
    )
    # totals come back by a join, since a feature may have more levels than a task can hold
    whole = wide.groupBy(*by, "feature").agg(
        F.count("*").alias("n_levels"),
        *[F.sum(f"n_{c}").alias(f"n_class_{c}") for c in CLASSES],
    )
    both = reduce(lambda a, b: a + b, [F.col(f"n_{c}") for c in CLASSES])
    sized = join_skewed(wide, whole, [*by, "feature"], "value", "inner").withColumn("n_all", both)

    def p(c: int) -> Column:
        level = (F.col(f"n_{c}") + smooth) / (F.col(f"n_class_{c}") + smooth * F.col("n_levels"))
        prior = F.try_divide(
            F.col(f"n_{c}") + prior_smooth, F.col("n_all") + prior_smooth * len(CLASSES)
        )
        # a class absent from training gets no prior
        seen_prior = F.when(F.col(f"n_{c}") > 0, prior)
        return F.when(F.col("feature") == ALL, seen_prior).otherwise(level)

    ratios = sized.withColumns({f"p_{c}": p(c) for c in CLASSES})
    ratios = materialize(ratios, "model")
    logs = ratios.select(
        *by, "feature", "value", *[F.ln(f"p_{c}").alias(f"log_{c}") for c in CLASSES]
    )
    return NaiveBayes(tuple(features), logs, ratios, tuple(by))


def fit_counts(
    counts: DataFrame,
    features: Sequence[str],
    used: Column | None = None,
    smooth: float = 1.0,
    prior_smooth: float = 0.0,
) -> NaiveBayes:
    """Fit from a table of :func:`count_levels`."""
    used = F.lit(True) if used is None else used
    return _model(features, counts, used, [], smooth, prior_smooth)


def fit(
    rows: DataFrame,
    label: str,
    features: Sequence[str],
    smooth: float = 1.0,
    prior_smooth: float = 0.0,
) -> NaiveBayes:
    """Fit on the labelled rows; unlabelled ones contribute their levels."""
    counts = count_levels(rows, label, features)
    return fit_counts(counts, features, None, smooth, prior_smooth)


def fit_folds(
    counts: DataFrame,
    features: Sequence[str],
    fold: str,
    k: int,
    used: Column | None = None,
    smooth: float = 1.0,
    prior_smooth: float = 0.0,
) -> NaiveBayes:
    """One model per left-out fold from one table of counts by fold.

    Each count takes part in all folds but its own. Rows without a fold only
    contribute their levels.
    """
    used = F.lit(True) if used is None else used
    spread = counts.withColumnRenamed(fold, "_in").select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias(fold)
    )
    outside = used & (F.col("_in") != F.col(fold))
    return _model(features, spread, outside, [fold], smooth, prior_smooth)


def predict(rows: DataFrame, model: NaiveBayes) -> DataFrame:
    """Adds ``log_0``, ``log_1`` and ``prediction``; missing or unknown values are skipped.

    While the model is small, its levels are one map per feature that each row looks its values
    up in. Beyond that the rows, numbered and written, meet the levels in long form, once for
    all features. Both add the logs in the order of the features.
    """
    scored = _from_maps(rows, model) if _few_levels(model) else _from_long(rows, model)
    names = [f"log_{c}" for c in CLASSES]
    return _choose(scored.select(*rows.columns, *names))


def _choose(scored: DataFrame) -> DataFrame:
    # a class absent from training has no prior and is never chosen
    wins = F.coalesce(F.col("log_1") > F.col("log_0"), F.col("log_1").isNotNull())
    return scored.withColumn("prediction", wins.cast("int"))


def _few_levels(model: NaiveBayes) -> bool:
    """Whether every map is short enough to look through and all of them fit a broadcast."""
    if not fits_broadcast(model.logs):
        return False
    sizes = model.logs.groupBy(*model.by, "feature").agg(F.count("*").alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= MAP_LEVELS


def _priors(model: NaiveBayes) -> DataFrame:
    """[by...], _prior_0, _prior_1: one row per fold, or one."""
    prior = [F.col(f"log_{c}").alias(f"_prior_{c}") for c in CLASSES]
    return model.logs.filter(F.col("feature") == ALL).select(*model.by, *prior)


def _from_maps(rows: DataFrame, model: NaiveBayes) -> DataFrame:
    logs = F.struct(*[F.col(f"log_{c}") for c in CLASSES])
    maps = [
        F.map_from_entries(
            F.collect_list(F.when(F.col("feature") == f, F.struct("value", logs.alias("logs"))))
        ).alias(f"_of_{i}")
        for i, f in enumerate(model.features)
    ]
    prior = [
        F.max(F.when(F.col("feature") == ALL, F.col(f"log_{c}"))).alias(f"_prior_{c}")
        for c in CLASSES
    ]
    whole = model.logs.groupBy(*model.by).agg(*prior, *maps)
    if model.by:
        known = rows.join(F.broadcast(whole), list(model.by), "left")  # one row per fold
        of = F.col
    else:
        one = whole.select(F.struct(*whole.columns).alias("_model")).scalar()
        known = rows.withColumn("_model", one)
        of = lambda name: F.col(f"_model.{name}")
    found = [
        F.try_element_at(of(f"_of_{i}"), F.col(f).cast("string"))
        for i, f in enumerate(model.features)
    ]

    def total(c: int) -> Column:
        parts = [F.coalesce(x[f"log_{c}"], F.lit(0.0)) for x in found]
        return reduce(lambda a, b: a + b, parts, of(f"_prior_{c}"))

    return known.withColumns({f"log_{c}": total(c) for c in CLASSES})


def _from_long(rows: DataFrame, model: NaiveBayes) -> DataFrame:
    by = list(model.by)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")  # pins the numbers
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(f).alias("feature"),
                F.col(f).cast("string").alias("value"),
            )
            for i, f in enumerate(model.features)
        ]
    )
    long = numbered.select("_row", *by, F.inline(entries)).filter(F.col("value").isNotNull())
    levels = model.logs.filter(F.col("feature") != ALL)
    met = join_skewed(long, levels, [*by, "feature", "value"], "_row", "inner")
    # one entry per feature
    parts = F.array_sort(F.collect_list(F.struct("place", *[f"log_{c}" for c in CLASSES])))
    known = numbered.join(met.groupBy("_row").agg(parts.alias("_parts")), "_row", "left")
    prior = _priors(model)
    if by:
        known = known.join(F.broadcast(prior), by, "left")  # one row per fold
    else:
        first = prior.first()  # one row
        known = known.withColumns(
            {f"_prior_{c}": F.lit(first[f"_prior_{c}"]).cast("double") for c in CLASSES}
        )

    def total(c: int) -> Column:
        added = F.aggregate("_parts", F.col(f"_prior_{c}"), lambda sum_, x: sum_ + x[f"log_{c}"])
        return F.coalesce(added, F.col(f"_prior_{c}"))

    return known.withColumns({f"log_{c}": total(c) for c in CLASSES})


def gaussian(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of numeric predictors per class."""
    numeric = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
            for c in columns
        ]
    )
    return (
        rows.filter(F.col(label).isNotNull())
        .select(F.col(label).alias("class"), F.inline(numeric))
        .groupBy("class", "feature")
        .agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    )


# Fixed value: stands in for a deviation or density of 0.
FLOOR = 0.001


def add_gaussian(scored: DataFrame, params: DataFrame) -> DataFrame:
    """Adds normal log densities to ``log_0`` and ``log_1`` of :func:`predict` and chooses anew.

    ``params`` comes from :func:`gaussian`: one row per class and numeric predictor, so few that
    they become literals. Missing values are skipped. A deviation of 0, or that of a class with
    one row, counts as ``FLOOR``, and so does a density too small for a double.
    """
    totals = {f"log_{c}": F.col(f"log_{c}") for c in CLASSES}
    for row in params.collect():
        sd = row["sd"] or FLOOR
        z = (F.col(row["feature"]).cast("double") - row["mean"]) / sd
        density = F.exp(z * z / -2) / (sd * math.sqrt(2 * math.pi))
        log = F.ln(F.when(density > 0, density).when(density == 0, FLOOR))
        name = f"log_{row['class']}"
        totals[name] = totals[name] + F.coalesce(log, F.lit(0.0))
    return _choose(scored.withColumns(totals))
