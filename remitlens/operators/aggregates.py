"""Grouped aggregates of the payment fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.functions.values import any_known, percent
from remitlens.operators.joins import join_skewed

#: Size of a quantile sketch; the rank of a quantile is off by 1.7 % of the rows at most, with a chance
#: of 99 percent.
SKETCH_K = 200
CENT_BITS = 11  # leading bits kept per bucket: at most 64 * 2**CENT_BITS buckets per sign


def totals_by(df: DataFrame, key: str, amount: str, n: str) -> DataFrame:
    """Total, number of payments, mean per payment and row count of each key."""
    total, payments = F.sum(amount), F.sum(n)
    return df.groupBy(key).agg(
        total.alias("total_amount"),
        payments.alias("total_payments"),
        F.try_divide(total.cast("double"), payments.cast("double")).alias("mean_amount"),
        F.count("*").alias("n_rows"),
    )


def share_of_total(
    df: DataFrame, key: str, by: Sequence[str], amount: str, name: str = "pct"
) -> DataFrame:
    """Percent of the key's total falling on each category combination.

    The fact is reduced to one row per key and category before the key total is
    formed, so the window holds at most one row per category and key.
    """
    sums = df.groupBy(key, *by).agg(F.sum(amount).alias("part_amount"))
    whole = F.sum("part_amount").over(Window.partitionBy(key))
    return sums.withColumn(name, percent(F.col("part_amount"), whole))


def attach_totals(
    df: DataFrame, key: Sequence[str], spread_by: str, **totals: Column
) -> DataFrame:
    """Every row with aggregates of its group, without gathering a group in one task.

    Rows with a null key form a group of their own.
    """
    grouped = df.groupBy(*key).agg(*[c.alias(n) for n, c in totals.items()])
    return join_skewed(df, grouped, key, spread_by, null_safe=True)


def _value_bucket(v: Column) -> Column:
    """Order-preserving bucket of a bigint: its length in bits, then its leading bits."""
    size = F.abs(v)
    bits = F.length(F.bin(size))
    lead = F.call_function("shiftright", size, F.greatest(bits - CENT_BITS, F.lit(0)))
    bucket = bits * (1 << CENT_BITS) + lead
    return F.when(v < 0, -bucket).otherwise(bucket).cast("int")


def exact_median(
    df: DataFrame, key: str, amount: str, name: str = "median_amount"
) -> DataFrame:
    """Exact median of a decimal amount per key, for keys of any size, the null key included.

    Equal amounts are counted before the shuffle and spread over (key, amount); the
    middle position is found among value buckets, whose number per key is fixed, and
    then inside the one or two buckets that hold it. Amounts are the whole numbers of
    the decimal's own scale; other types raise TypeError.
    """
    kind = df.schema[amount].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision > 18:
        raise TypeError(f"{amount} must be a decimal of at most 18 digits, not {kind}")
    unit = 10**kind.scale
    counted = (
        df.filter(F.col(amount).isNotNull())
        .groupBy(key, (F.col(amount) * unit).cast("bigint").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_b", _value_bucket(F.col("_v")))
    )
    by_key = Window.partitionBy(key)
    up_to = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole, until = F.sum("_nb").over(by_key), F.sum("_nb").over(up_to)
    buckets = (
        counted.groupBy(key, "_b")
        .agg(F.sum("_n").alias("_nb"))
        .select(
            F.col(key).alias("_key"),
            F.col("_b").alias("_bucket"),
            (until - F.col("_nb")).alias("_before"),
            until.alias("_until"),
            F.call_function("div", whole + 1, F.lit(2)).alias("_lo"),
            (F.call_function("div", whole, F.lit(2)) + 1).alias("_hi"),
        )
        .filter((F.col("_before") < F.col("_hi")) & (F.col("_lo") <= F.col("_until")))
    )
    inside = (
        Window.partitionBy(key, "_b")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket"))
    ranked = counted.join(buckets, same).withColumn(
        "_to", F.col("_before") + F.sum("_n").over(inside)
    )

    def holds(position: str) -> Column:
        return (F.col("_to") - F.col("_n") < F.col(position)) & (F.col(position) <= F.col("_to"))

    middle = F.sum(F.when(holds("_lo"), F.col("_v"))) + F.sum(F.when(holds("_hi"), F.col("_v")))
    return ranked.groupBy(key).agg((middle / (2.0 * unit)).alias(name))


def amount_sketches(df: DataFrame, key: str, amount: str, k: int = SKETCH_K) -> DataFrame:
    """One quantile sketch of a decimal amount per key, of a size that rows don't change.

    Sketches of several batches can be stored and merged. Null amounts are left out; a key with
    no more than ``k`` amounts is held exactly.
    """
    kind = df.schema[amount].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision > 18:
        raise TypeError(f"{amount} must be a decimal of at most 18 digits, not {kind}")
    units = (F.col(amount) * 10**kind.scale).cast("bigint")
    known = df.filter(F.col(amount).isNotNull())
    return known.groupBy(key).agg(
        F.kll_sketch_agg_bigint(units, F.lit(k)).alias("sketch"), F.lit(kind.scale).alias("scale")
    )


def merged_sketches(stored: DataFrame, key: str) -> DataFrame:
    """Sketches of the same key and scale from several batches as one."""
    return stored.groupBy(key, "scale").agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketched_median(sketches: DataFrame, key: str, name: str = "median_amount") -> DataFrame:
    """The lower median as the sketch has it."""
    middle = F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5).cast("double"))
    return sketches.select(key, (middle / F.pow(F.lit(10.0), "scale")).alias(name))


def any_by(df: DataFrame, key: str, **flags: str) -> DataFrame:
    """Three-valued any of 0/1 columns per key."""
    return df.groupBy(key).agg(*[any_known(F.col(c)).alias(n) for n, c in flags.items()])


def level_counts(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Rows per key, attribute and level for many attributes in one aggregation."""
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("attribute"), F.col(c).cast("string").alias("level"))
            for label, c in columns.items()
        ]
    )
    return (
        df.select(key, F.inline(pairs))
        .groupBy(key, "attribute", "level")
        .agg(F.count("*").alias("n"))
    )
