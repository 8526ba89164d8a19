"""Properties that hold whatever the data: shares, folds, splits, plans, models."""

import math

import pytest
from pyspark.sql import functions as F

from remitlens.models import bayes, trees
from remitlens.models.trees import BoostSettings
from remitlens.operators.ordering import bucket_digits
from remitlens.operators.reshape import feature_dictionary, one_hot, pivot_values
from remitlens.operators.splits import bootstrap, guard_leak, repeated_roles, role
from remitlens.plans import jobs
from remitlens.plans.clean import bayes_rows
from remitlens.plans.features import long_features, payment_blocks
from remitlens.schemas import AMOUNT, ID, LABEL, RECORD
from remitlens.sources.files import read_csv_blank_kept, read_csv_typed, write_csv
from tests.conftest import rows


def test_shares_sum_to_hundred(tables):
    totals = tables.pay.groupBy(F.col(ID).alias("id")).agg(F.sum(AMOUNT).alias("t"))
    shares = payment_blocks(tables.pay).filter(
        F.col("feature").startswith("NATURE_") | F.col("feature").startswith("FORM_")
    )
    sums = (
        shares.withColumn("block", F.substring_index("feature", "_", 1))
        .groupBy("id", "block")
        .agg(F.sum("value").alias("s"))
        .join(totals, "id")
    )
    off = sums.filter(
        F.abs(F.col("s") - F.when(F.col("t") > 0, 100.0).otherwise(0.0)) > 1e-6
    )
    assert off.count() == 0


def test_features_are_unique_per_recipient(tables):
    long = long_features(tables.phys, tables.pay, summary=True)
    assert long.groupBy("id", "feature").count().filter("count > 1").count() == 0
    assert long.filter(F.col("value").isNull()).count() == 0


def test_dictionary_is_dense(tables):
    found = feature_dictionary(payment_blocks(tables.pay))
    got = rows(found.select("idx", "feature"), "idx")
    assert [r[0] for r in got] == list(range(len(got)))
    assert [r[1] for r in got] == sorted(r[1] for r in got)


def test_vectors_equal_long_features(spark, tables):
    table = jobs.recipient_table(tables.phys, tables.pay)
    long = long_features(tables.phys, tables.pay)
    sums = {r[0]: r[1] for r in rows(long.groupBy("id").agg(F.sum("value")), "id")}
    names = {r.idx: r.feature for r in table.dictionary.collect()}
    got = table.rows.collect()
    assert len(got) == len(sums)
    for row in got:
        assert row.features.size == len(names)
        assert row.features.values.sum() == pytest.approx(sums[row.id])


def test_roles_are_disjoint_and_reproducible(spark):
    ids = spark.range(2000)
    first = rows(ids.select("id", role(1, "id", 0.25)), "id")
    assert first == rows(ids.select("id", role(1, "id", 0.25)), "id")
    share = sum(r[1] == "test" for r in first) / len(first)
    assert 0.2 < share < 0.3
    runs = repeated_roles(ids, "id", 3, 0.25)
    assert runs.count() == 6000


def test_bootstrap_draws_as_many_as_asked(spark):
    drawn = bootstrap(spark.range(1000), "id", 5, 4)
    assert drawn.agg(F.sum("draws")).first()[0] == 250
    assert drawn.count() == 1000


def test_leak_guard_keeps_everything_else(tables):
    test = tables.phys.select(F.col("id").alias(ID)).filter(F.col(ID) % 2 == 0)
    kept = guard_leak(tables.pay.select(RECORD, ID, LABEL), test)
    assert kept.filter((F.col(ID) % 2 == 0) & (F.col(LABEL) == "Yes")).count() == 0
    removed = tables.pay.filter((F.col(ID) % 2 == 0) & (F.col(LABEL) == "Yes")).count()
    assert kept.count() == tables.pay.count() - removed


def test_csv_null_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id long, s string")
    path = str(tmp_path / "with space .csv")
    write_csv(df, path)
    assert rows(read_csv_typed(spark, path, df.schema), "id") == [(1, "x"), (2, None), (3, None)]
    assert rows(read_csv_blank_kept(spark, path, df.schema), "id") == [(1, "x"), (2, ""), (3, None)]


def test_boosting_finds_the_planted_signal(spark):
    from remitlens.operators.reshape import assemble

    spine = spark.range(400).select("id", (F.col("id") % 8 == 0).cast("int").alias("label"))
    entries = spine.filter("label = 1 or id % 50 = 1").select(
        "id", F.lit(0).alias("idx"), F.lit(1.0).alias("value")
    )
    data = assemble(spine, entries, 2)
    settings = BoostSettings(rounds=3, depth=2, weight=None)
    model = trees.fit_boosted(data, settings)
    first = rows(trees.score(model, data).select("id", "score", "prediction"), "id")
    again = rows(trees.score(trees.fit_boosted(data, settings), data).select("id", "score", "prediction"), "id")
    assert first == again
    assert all(r[2] == 1 for r in first if r[0] % 8 == 0)


def test_transaction_vectors_hold_every_payment(tables):
    """One vector per payment and idle recipient; levels come from training rows."""
    table = jobs.transaction_table(tables.phys, tables.pay, tables.comp)
    idle = tables.phys.join(tables.pay, tables.phys.id == tables.pay.Physician_ID, "left_anti")
    assert table.rows.count() == tables.pay.count() + idle.count()
    names = {r.feature for r in table.dictionary.collect()}
    assert {"AMOUNT", "N_LICENSES", "N_PRODUCTS", "TYPE_ Drug"} <= names


def test_wide_forms_take_their_levels_from_the_data(spark):
    data = spark.createDataFrame(
        [(1, "a"), (1, "X DUMMY"), (2, None)], "id int, level string"
    )
    hot = one_hot(data, "level", "l_")
    assert hot.columns == ["id", "level", "l_X DUMMY", "l_a"]
    wide = pivot_values(data.withColumn("v", F.lit(1)), "id", "level", "v")
    assert sorted(map(tuple, wide.select("id", "X DUMMY", "a").collect())) == [(1, 1, 1), (2, 0, 0)]


def test_digest_buckets_follow_the_row_count():
    assert bucket_digits(10) == 2
    assert bucket_digits(10**12) == 6


def test_side_filter_is_below_the_recipient_join(tables):
    rows_ = bayes_rows(tables.phys, tables.pay, tables.comp)
    kept = rows_.filter(F.col("complete") & (F.col("split_set") == "test"))
    text = kept._jdf.queryExecution().optimizedPlan().toString()
    head = text[: text.index("Join")]
    assert "split_set" not in "".join(x for x in head.splitlines() if "Filter" in x)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["agg_percent_by_nature", "join_left_natural", "win_partition_total", "multihot_sum"]
)
def test_fact_plans_have_no_single_task_stage(spark, small, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text


def test_row_local_queries_do_not_shuffle(spark, small):
    import __spark_entry__ as entry

    for name in ("unpivot_multi_value", "split_holdout_rows"):
        assert "Exchange" not in plan(entry.queries()[name](spark, small)), name
    for name in ("multihot_sum", "assemble_matrix"):  # recipients and companies are broadcast
        assert "Exchange hashpartitioning" not in plan(entry.queries()[name](spark, small)), name


def test_scans_read_only_needed_columns(spark, small):
    import __spark_entry__ as entry

    text = plan(entry.queries()["agg_sum_by_key"](spark, small))
    assert "o_orderpriority" not in text and "o_orderdate" not in text


def test_normal_predictors_skip_missing_values_and_floor_deviations(spark):
    rows = spark.createDataFrame(
        [(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, None), (3, -1.0, 0.0, 1e6)],
        "k int, log_0 double, log_1 double, x double",
    )
    params = spark.createDataFrame(
        [(0, "x", 4.0, 2.0), (1, "x", 5.0, None)], "class int, feature string, mean double, sd double"
    )
    got = {r.k: r for r in bayes.add_gaussian(rows, params).collect()}
    assert got[1].log_1 == pytest.approx(math.log(1 / (bayes.FLOOR * math.sqrt(2 * math.pi))))
    assert got[1].log_0 == pytest.approx(math.log(math.exp(-0.125) / (2 * math.sqrt(2 * math.pi))))
    assert (got[2].log_0, got[2].log_1) == (0.0, 0.0)
    assert got[3].log_0 - got[3].log_1 == pytest.approx(-1.0)  # both densities floored
    assert [got[k].prediction for k in (1, 2, 3)] == [1, 0, 1]
