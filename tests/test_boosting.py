"""Stopping rounds and first trees of boosted fits."""

import math
from dataclasses import replace

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from remitlens.models import boosting, trees
from remitlens.session import materialize

SETTINGS = trees.BoostSettings(rounds=12, eta=0.1, depth=2)


@pytest.fixture(scope="module")
def data(spark):
    x = F.xxhash64("id") % 100
    noisy = F.when(F.col("id") % 7 == 0, F.col("id") % 2).otherwise((x > 10).cast("long"))
    rows = spark.range(400, numPartitions=2).select(
        "id", noisy.alias("label"),
        array_to_vector(F.array(x.cast("double"), (F.col("id") % 13).cast("double"))).alias("features"),
    )
    return materialize(rows)


def test_best_round_waits():
    losses = [5.0, 4.0, 4.2, 4.1, 3.9, 4.0, 4.0, 4.0, 4.0, 4.0, 1.0]
    assert trees.best_round(losses, 5) == (5, True)
    assert trees.best_round(losses, 6) == (11, False)
    assert trees.best_round(losses, 1) == (2, True)


def test_small_gains_do_not_end_boosting(data, monkeypatch):
    fitted = []
    fit = trees.fit_boosted

    def watched(rows, settings):
        fitted.append(rows.count())
        return fit(rows, settings)

    monkeypatch.setattr(trees, "fit_boosted", watched)
    model = trees.fit_patient(data, SETTINGS, F.col("id") % 5 == 0, 5)
    whole = fit(data.where("id % 5 <> 0"), SETTINGS)
    held = trees.training_rows(data.where("id % 5 = 0"), 1.0)
    want, _ = trees.best_round(whole.evaluateEachIteration(held), 5)
    assert model.getNumTrees == want > 1
    assert fitted[-1] == 400 and fitted[0] == 320


def test_first_trees_equal_a_shorter_fit(data):
    short = trees.fit_boosted(data, replace(SETTINGS, rounds=4))
    cut = trees.first_trees(trees.fit_boosted(data, SETTINGS), 4)
    scores = lambda m: {r.id: r.score for r in trees.score(m, data).collect()}
    assert scores(cut) == pytest.approx(scores(short))


def test_patience_on_the_training_loss_needs_no_other_fit(data):
    # steps this long make the loss rise after a while
    rows = trees.training_rows(data, 1.0)
    whole = boosting.boost(rows, 14, 1.9, 3, 0.6)
    want, stopped = trees.best_round(whole.losses, 2)
    assert stopped and len(whole.losses) == whole.rounds == 14
    patient = boosting.boost(rows, 14, 1.9, 3, 0.6, patience=2)
    assert patient.rounds == patient.model.getNumTrees == want
    assert len(patient.losses) == want + 2
    assert patient.losses == pytest.approx(whole.losses[: want + 2])


def test_scores_are_the_summed_margins(data, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 3)
    rows = trees.training_rows(data, None)
    fit = boosting.boost(rows, 8, 0.3, 3, 0.8)
    scored = trees.score(fit.model, rows).select("label", "score").collect()
    loss = -sum(math.log(r.score if r.label == 1 else 1 - r.score) for r in scored) / len(scored)
    assert loss == pytest.approx(fit.losses[-1])
    assert list(fit.losses[:3]) == sorted(fit.losses[:3], reverse=True)


def test_first_leaves_are_newton_steps(spark):
    rows = [(float(y), w, x) for y, w, x in [(1, 4.0, 0.0), (0, 1.0, 0.0), (1, 4.0, 1.0), (1, 4.0, 1.0), (0, 1.0, 1.0)]]
    table = spark.createDataFrame(rows * 8, "label double, weight double, x double")
    table = table.withColumn("features", array_to_vector(F.array("x")))
    fit = boosting.boost(table, 1, 1.0, 1)
    found = {r.x: r.score for r in trees.score(fit.model, table).select("x", "score").distinct().collect()}
    # gradient (4 * .5 - .5) over hessian (5 * .25), and (8 * .5 - .5) over (9 * .25)
    assert found[0.0] == pytest.approx(1 / (1 + math.exp(-1.5 / 1.25)))
    assert found[1.0] == pytest.approx(1 / (1 + math.exp(-3.5 / 2.25)))


def test_rows_without_labels_cannot_be_boosted(data):
    with pytest.raises(ValueError):
        boosting.fit_continued(data.where("id < 0"), SETTINGS, 5)
