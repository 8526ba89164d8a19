"""Feature blocks joined by id, and holdouts that fit a model."""

import pytest
from pyspark.sql import functions as F

from remitlens.models import trees
from remitlens.models.trees import BoostSettings
from remitlens.operators.splits import repeated_roles
from remitlens.plans import blocks, jobs
from tests.conftest import rows

LONG = "id int, feature string, value double"


def two_blocks(spark):
    return {
        "first": spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (9, "a", 5.0)], LONG),
        "second": spark.createDataFrame([(2, "a", 3.0), (None, "x", 4.0)], LONG),
    }


def test_blocks_meet_on_the_id(spark):
    spine = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, label int")
    got = rows(blocks.join_blocks(spine, two_blocks(spark)), "id")
    assert [r[:2] for r in got] == [(1, 10), (2, 20), (3, 30)]
    plain = [tuple([tuple(e) for e in block] for block in r[2:]) for r in got]
    assert plain == [([("a", 1.0), ("b", 2.0)], []), ([], [("a", 3.0)]), ([], [])]


def test_empty_blocks_and_bad_names(spark):
    spine = spark.createDataFrame([(1, 10)], "id int, first int")
    with pytest.raises(ValueError, match="named like columns: first"):
        blocks.join_blocks(spine, two_blocks(spark))
    with pytest.raises(ValueError, match="no blocks"):
        blocks.stack({})
    none = {"empty": spark.createDataFrame([], LONG)}
    assert rows(blocks.join_blocks(spine, none), "id") == [(1, 10, [])]


def test_dictionaries_tell_equal_names_of_two_blocks_apart(spark):
    sides = spark.createDataFrame([(1, "train"), (2, "test"), (9, "test")], "id int, side string")
    found = blocks.block_dictionary(two_blocks(spark), sides, F.col("side") == "test")
    assert rows(found, "block", "feature") == [
        ("first", "a", 1, 1), ("first", "b", 1, 0), ("second", "a", 0, 1),
    ]


def test_registry_holds_all_recipient_features(tables):
    from remitlens.plans.features import attribute_blocks, payment_blocks

    known = blocks.recipient_blocks(tables.phys, tables.pay)
    assert tuple(known) == blocks.BLOCKS and all(not long.isEmpty() for long in known.values())
    whole = payment_blocks(tables.pay).unionByName(attribute_blocks(tables.phys))
    assert rows(blocks.stack(known).drop("block"), "id", "feature") == rows(whole, "id", "feature")


@pytest.mark.parametrize("rolled", [False, True])
def test_holdouts_fit_on_what_they_leave(spark, tables, monkeypatch, rolled):
    table = jobs.transaction_table(tables.phys, tables.pay, tables.comp).train
    key = "id" if rolled else "Record_ID"
    seen = []
    fit = trees.fit_boosted

    def watched(given, settings):
        seen.append({r[0] for r in given.select(key).collect()})
        return fit(given, settings)

    monkeypatch.setattr(trees, "fit_boosted", watched)
    settings = BoostSettings(rounds=2, depth=2, threshold=0.02)
    got = rows(jobs.repeated_holdouts(table, settings, key, 3, 0.25, rolled), "run")
    known = table.filter("label is not null")
    roles = rows(repeated_roles(known, key, 3, 0.25).distinct(), "run", key)
    for run, tp, fp, fn, tn, _ in got:
        held = {k for k, r, role in roles if r == run and role == "test"}
        left = {k for k, r, role in roles if r == run and role == "train"}
        assert left in seen and not held & left
        assert tp + fp + fn + tn == len(held)
    assert len(got) == len(seen) == 3
