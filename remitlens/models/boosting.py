"""Boosting that goes on from where it stands.

The margin of every row is a column. Each round fits one regression tree of Spark ML to the
gradient, in Newton form: the target is gradient over hessian and the row's weight is the hessian, so
that a leaf's mean is the second-order step. The loss on the training rows comes from the same
aggregation as the sum of hessians for the next round. A round more costs one tree, so patience on
the training loss ends a fit without another one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.models.trees import MAX_DEPTH, BoostSettings, best_round, training_rows
from remitlens.session import materialize

#: Rounds after which the margins are written anew; in between the trees since then are applied.
WRITE_EVERY = 10
#: Least hessian of a row, and the least sum of hessians of a leaf, as known boosters have it.
LEAST_HESSIAN = 1e-6
LEAST_LEAF = 1.0
#: Least rows of one partition; a level of a tree is one pass over them.
ROWS_PER_PARTITION = 2_000
#: Every partition keeps the statistics of all open nodes, so there are no more partitions than the
#: cluster works on at once, unless they would hold more rows than this.
MOST_ROWS = 250_000


@dataclass(frozen=True)
class BoostedFit:
    """The model after ``rounds`` rounds of all tried, and the training loss after each."""

    model: GBTClassificationModel
    rounds: int
    losses: tuple[float, ...]


def _ensemble(kind, name: str, trees: Sequence, weight: float):
    """A Spark ML model whose score is the weighted sum of the trees."""
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    listed = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        listed[i], weights[i] = tree._java_obj, weight
    family = "classification" if kind is GBTClassificationModel else "regression"
    made = getattr(getattr(jvm.org.apache.spark.ml, family), kind.__name__)(name, listed, weights)
    return kind(made).setFeaturesCol("features")


def boosted_model(trees: Sequence, eta: float) -> GBTClassificationModel:
    """The classifier of the trees; its probability is that of the summed margins."""
    # that model's probability is the logistic of twice its score
    return _ensemble(GBTClassificationModel, f"boosted_{len(trees)}", trees, eta / 2)


def _chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _loss(label: Column, margin: Column) -> Column:
    """Log loss from the margin, without overflow."""
    signed = F.when(label == 1, -margin).otherwise(margin)
    return F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))


def partitions_of(n_rows: int, at_once: int) -> int:
    """Partitions for so many rows on a cluster that runs ``at_once`` tasks."""
    fine = -(-n_rows // ROWS_PER_PARTITION)
    return max(1, min(fine, max(at_once, -(-n_rows // MOST_ROWS))))


def boost(
    rows: DataFrame,
    rounds: int,
    eta: float,
    depth: int,
    subsample: float = 1.0,
    seed: int = 2021,
    patience: int | None = None,
) -> BoostedFit:
    """Boosted trees on (label 0 or 1, weight, features), of at most ``rounds`` rounds.

    With ``patience`` boosting ends after so many rounds without a lower mean loss on the training
    rows, each row counting once, and the model is that of the best round. Subsamples are drawn by
    digest of the row's number and the round, so a lost executor's rows come out the same.
    Boosting also ends once the hessians of all rows do not fill two leaves: no tree could split. Leaves hold a sum of hessians of at least 1. There is no least gain of a split and no penalty on
    leaf values. Without rows it raises ValueError.
    """
    n = rows.count()
    if not n:
        raise ValueError("boosting needs labelled rows")
    parts = partitions_of(n, rows.sparkSession.sparkContext.defaultParallelism)
    base = rows.select("label", "weight", "features", F.monotonically_increasing_id().alias("row"))
    written = materialize(
        base.withColumn("margin", F.lit(0.0)).repartition(parts, F.xxhash64("row")), "margins"
    )
    label, margin = F.col("label"), F.col("margin")
    p = _chance(margin)
    hessian = F.greatest(p * (1 - p), F.lit(LEAST_HESSIAN))
    measure = [F.avg(_loss(label, margin)).alias("loss"), F.sum(F.col("weight") * hessian).alias("h")]
    now = written
    total = now.agg(*measure).first()["h"]
    trees, losses, recent = [], [], []
    for turn in range(1, rounds + 1):
        targets = now.select(
            "features",
            ((label - p) / hessian).alias("target"),
            (F.col("weight") * hessian).alias("pull"),
            "row",
        )
        if subsample < 1:
            draw = F.pmod(F.xxhash64("row", F.lit(seed), F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
            targets = targets.where(draw < subsample)
        tree = DecisionTreeRegressor(
            featuresCol="features",
            labelCol="target",
            weightCol="pull",
            maxDepth=depth,
            minWeightFractionPerNode=min(LEAST_LEAF / max(total * subsample, LEAST_LEAF), 0.49),
            maxMemoryInMB=1024,
            seed=seed + turn,
        ).fit(targets)
        trees.append(tree)
        recent.append(tree)
        step = _ensemble(GBTRegressionModel, f"step_{turn}", recent, eta).setPredictionCol("step")
        moved = step.transform(written).withColumn("margin", margin + F.col("step")).drop("step")
        if len(recent) == WRITE_EVERY:
            written, recent = materialize(moved, "margins"), []
            moved = written
        now = moved
        seen = now.agg(*measure).first()
        total = seen["h"]
        losses.append(float(seen["loss"]))
        stopped = patience is not None and best_round(losses, patience)[1]
        if stopped or total < 2 * LEAST_LEAF:
            break
    used = best_round(losses, patience)[0] if patience is not None else len(trees)
    return BoostedFit(boosted_model(trees[:used], eta), used, tuple(losses))


def fit_continued(rows: DataFrame, settings: BoostSettings, patience: int | None) -> BoostedFit:
    """Boosting by the settings on all labelled rows, ended by patience on their own loss."""
    if settings.depth > MAX_DEPTH:
        raise ValueError(f"depth {settings.depth} is beyond the limit of {MAX_DEPTH}")
    train = training_rows(rows, settings.weight)
    return boost(
        train, settings.rounds, settings.eta, settings.depth, settings.subsample, settings.seed, patience
    )
