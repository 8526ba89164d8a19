"""How much work boosted fits do; their results are those of the plain way."""

from dataclasses import replace

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from remitlens.models import boosting, trees
from remitlens.plans import jobs
from remitlens.schemas import AMOUNT, FORM, LICENSES, NATURE, PRODUCT_TYPES, SPECIALTIES
from remitlens.session import materialize

SETTINGS = trees.BoostSettings(rounds=30, eta=0.9, depth=12)


@pytest.fixture(scope="module")
def noise(spark):
    """Labels that no feature tells, so that held-out loss only rises."""
    label = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2))
    x = (F.xxhash64("id", F.lit(5)) % 1000).cast("double")
    return materialize(
        spark.range(600, numPartitions=6).select("id", label.alias("label"), array_to_vector(F.array(x)).alias("features"))
    )


def test_the_first_try_is_the_shortest_that_can_end(noise, monkeypatch):
    fitted = []
    fit = trees.fit_boosted

    def watched(rows, settings):
        fitted.append(settings.rounds)
        return fit(rows, settings)

    monkeypatch.setattr(trees, "fit_boosted", watched)
    model = trees.fit_patient(noise, SETTINGS, F.col("id") % 5 == 0, 5)
    assert fitted == [6, 1] and model.getNumTrees == 1


def test_tries_grow_and_can_end():
    assert trees.next_try(6, 6, 5) == 12
    assert trees.next_try(6, 2, 5) == 7
    for patience in range(1, 7):
        for tried in range(patience + 1, 50):
            for best in range(tried - patience + 1, tried + 1):  # otherwise it has ended
                assert trees.next_try(tried, best, patience) > tried
                assert trees.next_try(tried, best, patience) >= best + patience or best == tried


def test_deep_trees_meet_their_rows_in_few_partitions(noise, monkeypatch):
    seen = []

    class Watched(trees.GBTClassifier):
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count(), self.getMaxMemoryInMB()))
            return super().fit(rows)

    monkeypatch.setattr(trees, "GBTClassifier", Watched)
    rows = noise.repartition(40, "id")
    trees.fit_boosted(rows, replace(SETTINGS, rounds=1))
    trees.fit_boosted(rows, replace(SETTINGS, rounds=1, depth=3))
    assert [n for n, _, _ in seen] == [trees.LEAST_PARTITIONS, 40]
    assert all(n == 600 and mb == trees.NODE_MEMORY_MB for _, n, mb in seen)
    assert trees.deep_partitions(10_000_000) == 40


def test_margins_have_no_partition_for_every_few_rows():
    assert boosting.partitions_of(600, 12) == 1
    assert boosting.partitions_of(16_000, 12) == 8
    assert boosting.partitions_of(700_000, 12) == 12  # 350 before, each with the statistics of all nodes
    assert boosting.partitions_of(30_000_000, 12) == 120


def test_fits_side_by_side_share_the_memory(noise, monkeypatch):
    """Rows of more fits than the executors keep would be driven out by each other."""
    one_fit = 600 * (jobs.ROW_BYTES + 4)
    for memory, at_once in ((0, 1), (1.5, 1), (2.5, 2), (99, jobs.FITS_AT_ONCE)):
        monkeypatch.setattr(jobs, "storage_bytes", lambda _: memory * one_fit / jobs.CACHE_SHARE)
        assert jobs.fits_at_once(noise) == at_once
    assert jobs.fits_at_once(noise.where("id < 0")) == jobs.FITS_AT_ONCE


def test_storage_is_that_of_the_session(spark):
    assert jobs.storage_bytes(spark) > 1 << 20


def test_holdouts_and_folds_ask_how_many_fits_the_memory_holds(noise, monkeypatch):
    asked = []

    def side_by_side(spark, work, calls, at_once=jobs.FITS_AT_ONCE):
        asked.append(at_once)
        return [noise] * len(calls)

    monkeypatch.setattr(jobs, "fits_at_once", lambda rows: 3)
    monkeypatch.setattr(jobs, "side_by_side", side_by_side)
    jobs.repeated_holdouts(noise, SETTINGS, "id", 2, 0.25, rolled=False)
    jobs.cross_validate(noise, [SETTINGS], 2)
    assert asked == [3, 3]


def test_entries_are_counted_slot_by_slot(spark):
    """No function over the tokens of a row for each of them; counts and order as in plain Python."""
    groups = {
        "COUNTRY_": ["Company_Country"], "FORM_": [FORM], "NATURE_": [NATURE],
        "RELATED_": ["Related_Product_Indicator"], "TYPE_": PRODUCT_TYPES,
        "SPEC_": SPECIALTIES, "LICENSE_": LICENSES,
    }
    names = [c for g in groups.values() for c in g]
    levels = [None, "", "a", "a", "b c", "null"]
    lines = [
        (i, None if i % 5 == 0 else float(i), i % 4, i % 3, *[levels[(i * 7 + i // 3 * j + j) % 6] for j in range(len(names))])
        for i in range(60)
    ]
    kinds = ["id long", f"{AMOUNT} double", "Number_of_licenses int", "Number_of_related_products int"]
    df = spark.createDataFrame(lines, ", ".join(kinds + [f"{c} string" for c in names]))
    entries = df.select("id", jobs.transaction_entries().alias("entries"))
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") <= 1
    for row, got in zip(df.orderBy("id").collect(), entries.orderBy("id").collect(), strict=True):
        want = [("AMOUNT", row[AMOUNT] or 0.0), ("N_LICENSES", row[2]), ("N_PRODUCTS", row[3])]
        tokens = [f"{p} {row[c]}" for p, g in groups.items() for c in g if row[c] is not None]
        want += [(t, tokens.count(t)) for t in dict.fromkeys(tokens)]
        assert [tuple(e) for e in got.entries] == want
