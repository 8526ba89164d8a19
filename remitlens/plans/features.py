"""Long feature table of recipients: ``(id, feature, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions.values import any_known, percent, prefixed, yes_no
from remitlens.operators.aggregates import exact_median, totals_by
from remitlens.operators.reshape import assemble, compact_array, index_features
from remitlens.plans.clean import split_specialties
from remitlens.schemas import (
    AMOUNT,
    COMPANY,
    FORM,
    ID,
    LABEL,
    LICENSES,
    N_PAYMENTS,
    NATURE,
    SPECIALTIES,
)


def labels(pay: DataFrame) -> DataFrame:
    """Recipients having payments, with their three-valued label."""
    return pay.groupBy(F.col(ID).alias("id")).agg(
        any_known(yes_no(F.col(LABEL))).alias("label")
    )


def payment_features(pay: DataFrame) -> DataFrame:
    """block, id, feature, value: shares by nature, form, type, amounts by company, in one pass.

    Each payment lists its four categories; one aggregation sums them per recipient.
    Partial sums are formed before the shuffle, and the shuffle key includes the
    category. Totals are then taken over the recipient's categories of one block.
    """

    def entry(block: str, prefix: str, column: str) -> Column:
        level = F.col(column)
        feature = F.when(level.isNotNull(), prefixed(prefix, level))
        return F.struct(F.lit(block).alias("block"), feature.alias("feature"))

    entries = F.array(
        entry("nature", "NATURE_", NATURE),
        entry("form", "FORM_", FORM),
        entry("type", "TYPE_", "Product_Type_1"),
        entry("company", "COMP_", COMPANY),
    )
    sums = (
        pay.select(F.col(ID).alias("id"), AMOUNT, F.inline(entries))
        .groupBy("id", "block", "feature")
        .agg(F.sum(AMOUNT).alias("part"))
    )
    whole = F.sum("part").over(Window.partitionBy("id", "block"))
    value = F.when(F.col("block") == "company", F.col("part").cast("double")).otherwise(
        F.coalesce(percent(F.col("part"), whole), F.lit(0.0))
    )
    return sums.select("block", "id", "feature", value.alias("value")).filter(
        F.col("feature").isNotNull()
    )


def payment_blocks(pay: DataFrame) -> DataFrame:
    """All features of :func:`payment_features`, blocks told apart by their prefixes."""
    return payment_features(pay).drop("block")


def attribute_features(phys: DataFrame) -> DataFrame:
    """block, id, feature, value: license and specialty indicators of recipients."""

    def tagged(block: str, prefix: str, values: list[str]) -> Column:
        def entry(level: Column) -> Column:
            return F.struct(F.lit(block).alias("block"), prefixed(prefix, level).alias("feature"))

        return F.transform(compact_array(values), entry)

    owned = F.array_distinct(
        F.concat(tagged("license", "LICENSE_", LICENSES), tagged("specialty", "SPEC_", SPECIALTIES))
    )
    people = split_specialties(phys).select("id", F.inline(owned))
    return people.select("block", "id", "feature", F.lit(1.0).alias("value"))


def attribute_blocks(phys: DataFrame) -> DataFrame:
    """All features of :func:`attribute_features`."""
    return attribute_features(phys).drop("block")


def summary_block(pay: DataFrame) -> DataFrame:
    """Total, payment count, mean and median amount of recipients; 0 where nothing is known."""
    totals = totals_by(pay, ID, AMOUNT, N_PAYMENTS)
    wide = totals.join(exact_median(pay, ID, AMOUNT), ID, "left").select(
        F.col(ID).alias("id"),
        F.col("total_amount").cast("double").alias("TOTAL_AMOUNT"),
        F.col("total_payments").cast("double").alias("TOTAL_PAYMENTS"),
        F.col("mean_amount").alias("MEAN_AMOUNT"),
        F.col("median_amount").alias("MEDIAN_AMOUNT"),
    )
    long = wide.unpivot(["id"], [c for c in wide.columns if c != "id"], "feature", "value")
    return long.na.fill(0.0, ["value"])


def long_features(phys: DataFrame, pay: DataFrame, summary: bool = False) -> DataFrame:
    """All blocks of recipients that have payments."""
    active = pay.select(F.col(ID).alias("id")).distinct()
    long = payment_blocks(pay).unionByName(attribute_blocks(phys).join(active, "id", "left_semi"))
    return long.unionByName(summary_block(pay)) if summary else long


def align(long: DataFrame, in_test: Column) -> DataFrame:
    """Features with the number of training and of test rows carrying each."""
    return long.groupBy("feature").agg(
        F.count(F.when(~in_test, 1)).alias("n_train"), F.count(F.when(in_test, 1)).alias("n_test")
    )


def one_side() -> Column:
    """The only side that has a feature, from ``n_train`` and ``n_test``; null if both have it."""
    only = F.when(F.col("n_test") == 0, "train").when(F.col("n_train") == 0, "test")
    return only.alias("only_in")


def one_sided(aligned: DataFrame) -> DataFrame:
    """Features found on one side only."""
    return aligned.select(one_side(), "feature").filter(F.col("only_in").isNotNull())


def vectors(long: DataFrame, spine: DataFrame, dictionary: DataFrame, size: int) -> DataFrame:
    """A written table of the ``spine`` columns beside one sparse vector per id."""
    return assemble(spine, index_features(long, dictionary), size)
