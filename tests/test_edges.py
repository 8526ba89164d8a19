"""Literal edge rows: nulls, zeros, boundary values, missing partners."""

import pytest
from pyspark.sql import functions as F

from remitlens.functions import bins
from remitlens.functions.values import (
    any_known,
    count_parts,
    parse_us_date,
    percent,
    split_parts,
    strict_sum,
    yes_no,
)
from remitlens.models.evaluate import best_run, evaluate
from remitlens.operators.columns import ending_with, relocate, starting_with
from remitlens.operators.missing import completeness, fill_sentinel
from remitlens.operators.ordering import hash_folds, with_fold, with_row_index
from remitlens.operators.reshape import (
    assemble,
    one_hot,
    pivot_values,
    slot_counts,
    unpivot_groups,
    unpivot_slots,
)
from remitlens.plans.features import align, one_sided, summary_block
from tests.conftest import rows


def column(spark, kind, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def mapped(df, expr):
    return [r[1] for r in rows(df.select("i", expr), "i")]


def test_three_valued_any(spark):
    df = spark.createDataFrame(
        [(1, None), (1, 0), (2, 1), (2, None), (3, 0)], "id int, f int"
    )
    assert rows(df.groupBy("id").agg(any_known(F.col("f"))), "id") == [(1, None), (2, 1), (3, 0)]


def test_strict_sum(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (2, 3), (2, 4)], "id int, x int")
    assert rows(df.groupBy("id").agg(strict_sum(F.col("x"))), "id") == [(1, None), (2, 7)]


def test_right_closed_bins(spark):
    df = column(spark, "double", [0.0, 0.01, 10.0, 10.01, 15.0, 100.0, 100.01, -1.0, None])
    got = mapped(df, bins.cut(F.col("x"), bins.AMOUNT_BREAKS))
    assert got == [None, 1, 1, 2, 2, 11, 12, None, None]
    labels = mapped(df, bins.cut_label(F.col("x"), bins.AMOUNT_BREAKS))
    assert labels[1] == "(0,10]" and labels[6] == "(100,Inf)" and labels[0] is None
    open_low = mapped(df, bins.cut(F.col("x"), bins.TOTAL_BREAKS))
    assert open_low[7] == 1 and open_low[8] is None


def test_percent_bins_leave_zero_and_more_out(spark):
    df = column(spark, "double", [0.0, 25.0, 25.1, 100.0, 100.01])
    assert mapped(df, bins.cut(F.col("x"), bins.PERCENT_BREAKS)) == [None, 1, 2, 4, None]


def test_count_bands(spark):
    df = column(spark, "int", [1, 4, 5, 6, 7, 11, 12, 16, 17, 20, 21, 0, None])
    expected = "1 4 5-6 5-6 7-11 7-11 12-16 12-16 17-20 17-20 20+ 20+ 20+".split()
    assert mapped(df, bins.count_band(F.col("x"))) == expected


def test_split_and_count_parts(spark):
    df = column(spark, "string", ["a", "a|b", "a|b|c|d", None])
    got = rows(df.select("i", *split_parts(F.col("x"), ["s1", "s2", "s3"])), "i")
    assert [r[1:] for r in got] == [
        ("a", None, None), ("a", "b", None), ("a", "b", "c"), (None, None, None)
    ]
    assert mapped(df, count_parts(F.col("x"))) == [1, 2, 4, None]


def test_dates_and_labels(spark):
    df = column(spark, "string", ["01/31/2013", "1/3/2014", "13/40/2013", "", None])
    got = mapped(df, parse_us_date(F.col("x")).cast("string"))
    assert got == ["2013-01-31", "2014-01-03", None, None, None]
    flags = column(spark, "string", ["Yes", "No", "maybe", None])
    assert mapped(flags, yes_no(F.col("x"))) == [1, 0, None, None]


def test_percent_of_zero_is_null(spark):
    df = column(spark, "int", [0, 50])
    assert mapped(df, percent(F.lit(5), F.col("x"))) == [None, 10.0]


@pytest.mark.parametrize(("n", "k", "sizes"), [(11, 3, [4, 3, 4]), (10, 3, [4, 3, 3]), (1, 5, [1])])
def test_fold_widths(spark, n, k, sizes):
    df = with_fold(spark.range(1, n + 1).withColumnRenamed("id", "row_index"), k)
    assert [r[1] for r in rows(df.groupBy("fold").count(), "fold")] == sizes


def test_row_index_is_dense_and_ordered(spark):
    ids = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5003).alias("key"))
    got = rows(with_row_index(ids, "key"), "key")
    assert [r[1] for r in got] == list(range(1, 5001))


def test_hash_folds_partition_the_ids(spark):
    folds = hash_folds(spark.range(1000), "id", 3, 4)
    sizes = [r[1] for r in rows(folds.groupBy("fold").count(), "fold")]
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) <= 1
    assert folds.select("id").distinct().count() == 1000


def test_balanced_accuracy(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 8 + [(0, 1)] * 2
    scored = spark.createDataFrame(pairs, "truth int, prediction int")
    row = evaluate(scored).first()
    assert (row.tp, row.fn, row.tn, row.fp) == (3, 1, 8, 2)
    assert row.bac == pytest.approx(0.775)
    assert evaluate(scored.filter("truth = 0")).first().bac is None


def test_best_run_takes_first_of_equals(spark):
    runs = spark.createDataFrame(
        [(1, 0.5, "a"), (2, 0.8, "b"), (3, 0.8, "c"), (4, None, "d")],
        "run int, bac double, name string",
    )
    assert best_run(runs, "name").first().name == "b"


def test_unpivots(spark):
    one = spark.createDataFrame(
        [(1, "CA", None, "NY"), (2, None, None, None)],
        "id int, License_State_1 string, License_State_2 string, License_State_3 string",
    )
    got = rows(unpivot_slots(one, ["id"], "license_state_", "slot", "state"), "slot")
    assert got == [(1, 1, "CA"), (1, 3, "NY")]
    many = spark.createDataFrame(
        [(1, None, "T1", None, None)],
        "id int, P_Code_1 string, P_Type_1 string, P_Code_2 string, P_Type_2 string",
    )
    found = unpivot_groups(many, ["id"], "P_", ["Code", "Type"], 2, "slot")
    assert rows(found, "slot") == [(1, 1, None, "T1")]


def test_multi_hot_counts_repeats(spark):
    df = spark.createDataFrame([("a", "b", "a"), (None, None, None)], "x string, y string, z string")
    got = df.select(slot_counts(["x", "y", "z"]).alias("p")).collect()
    assert sorted((p.level, p.n) for p in got[0].p) == [("a", 2), ("b", 1)]
    assert got[1].p == []


def test_one_hot_of_null_is_zero(spark):
    df = column(spark, "string", ["a", None])
    assert rows(one_hot(df, "x", "is_", ["a", "b"]).drop("x"), "i") == [(0, 1, 0), (1, 0, 0)]


def test_alignment_covers_both_sides(spark):
    long = spark.createDataFrame(
        [("A", "train"), ("B", "train"), ("B", "test"), ("C", "test")], "feature string, side string"
    )
    both = align(long, F.col("side") == "test")
    assert rows(both, "feature") == [("A", 1, 0), ("B", 1, 1), ("C", 0, 1)]
    assert rows(one_sided(both), "feature") == [("train", "A"), ("test", "C")]


def test_sentinel_fills_text_only(spark):
    df = spark.createDataFrame([(None, None), (1, "x")], "n int, s string")
    assert rows(fill_sentinel(df), "s") == [(None, "DUMMY"), (1, "x")]
    assert dict(rows(completeness(df), "column_name")) == {"n": 0.5, "s": 0.5}


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "License_1 int, b_Travel int, LICENSE_2 int")
    assert starting_with(df, "license_") == ["License_1", "LICENSE_2"]
    assert ending_with(df, "travel") == ["b_Travel"]
    assert relocate(df, "b_Travel").columns == ["b_Travel", "License_1", "LICENSE_2"]


def test_csv_keeps_quotes_spaces_and_line_breaks(spark, tmp_path):
    from pyspark.sql import types as T

    from remitlens.sources.files import read_csv_blank_kept, read_csv_typed, write_csv

    texts = [T.StructField(c, T.StringType()) for c in ("a", "b")]
    schema = T.StructType([T.StructField("id", T.IntegerType()), *texts])
    data = [(1, 'He said "x", then left', "after"), (2, "  lead ", "two\nlines"), (3, None, "NA,")]
    write_csv(spark.createDataFrame(data, schema).coalesce(1), str(tmp_path / "f"))
    for read in (read_csv_typed, read_csv_blank_kept):
        got = read(spark, str(tmp_path / "f"), schema, multi_line=True)
        assert sorted(map(tuple, got.collect())) == data


def test_depth_beyond_the_limit_is_an_error(spark):
    from remitlens.models.trees import BoostSettings, fit_boosted

    with pytest.raises(ValueError, match="depth"):
        fit_boosted(spark.range(1), BoostSettings(rounds=1, eta=0.1, depth=70))


def test_a_feature_called_null_is_not_the_missing_one(spark):
    data = spark.createDataFrame([(1, "null", 5), (2, None, 7)], "i int, f string, v int")
    assert rows(pivot_values(data, "i", "f", "v"), "i") == [(1, 5), (2, 0)]


def test_more_levels_than_a_table_can_hold_are_an_error(spark):
    key = "spark.sql.pivotMaxValues"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        with pytest.raises(ValueError, match="more than 3 levels"):
            one_hot(spark.range(4), "id", "is_")
        assert len(one_hot(spark.range(3), "id", "is_").columns) == 4
    finally:
        spark.conf.set(key, before)


def test_vectors_keep_values_as_they_are(spark):
    entries = [(1, 0, 0.1 + 0.2), (1, 1, None), (1, 2, float("inf")), (3, 1, -1e-300)]
    indexed = spark.createDataFrame(entries, "id long, idx int, value double")
    built = assemble(spark.range(1, 4), indexed, 4)
    found = {r.id: (r.features.size, dict(zip(r.features.indices.tolist(), r.features.values.tolist()))) for r in built.collect()}
    assert found == {1: (4, {0: 0.1 + 0.2, 2: float("inf")}), 2: (4, {}), 3: (4, {1: -1e-300})}


def test_summary_of_unknown_amounts_is_zero(spark, tables):
    unknown = tables.pay.limit(3).withColumns(
        {"Total_Amount_of_Payment_USDollars": F.lit(None).cast("decimal(18,2)"), "Physician_ID": F.lit(7)}
    )
    found = {r.feature: r.value for r in summary_block(unknown).collect()}
    payments = unknown.agg(F.sum("Number_of_Payments")).first()[0]
    assert found == {"TOTAL_AMOUNT": 0, "TOTAL_PAYMENTS": payments, "MEAN_AMOUNT": 0, "MEDIAN_AMOUNT": 0}
