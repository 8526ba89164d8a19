"""Row positions and contiguous folds without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions.values import hash_key
from remitlens.session import materialize

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above 33 bits
_BUCKET_ROWS = 1 << 18  # rows a digest bucket may hold on average


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """1-based position in the given order; ``order`` must identify rows.

    A range-partitioned sort numbers rows inside each partition; the numbers are
    written out, since a second evaluation could draw other range bounds, and then
    shifted by the sizes of the partitions before.
    """
    local = F.monotonically_increasing_id()
    placed = materialize(df.orderBy(*order).withColumn("_m", local), "ordered")
    part = F.shiftright("_m", _PART_BITS)
    before = (
        placed.groupBy(part.alias("_p"))
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    # one row per written partition
    joined = placed.withColumn("_p", part).join(F.broadcast(before), "_p")
    inside = F.col("_m") - F.shiftleft(F.col("_p"), _PART_BITS)
    return joined.withColumn(name, F.col("_before") + inside + 1).drop("_p", "_m", "_before")


def bind_by_position(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Row i of ``left`` beside row i of ``right``, each in its own order.

    The orders must identify rows. Different lengths or a shared column name are errors.
    """
    if shared := set(left.columns) & set(right.columns):
        raise ValueError(f"both frames have {sorted(shared)}")
    first = with_row_index(left, *left_order, name="_position")
    second = with_row_index(right, *right_order, name="_position")
    sizes = first.count(), second.count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"{sizes[0]} rows can't be bound to {sizes[1]}")
    return first.join(second, "_position").drop("_position")


def number_levels(pairs: DataFrame, column: str = "column_name", level: str = "level") -> DataFrame:
    """Distinct (column, level) pairs with the 1-based number of the level in its column.

    One range-partitioned sort numbers the levels of all columns; the first number of each column
    is taken off, so no window holds a column. Null is no level.
    """
    placed = with_row_index(pairs.filter(F.col(level).isNotNull()).distinct(), column, level, name="_i")
    # one row per column
    first = F.broadcast(placed.groupBy(column).agg(F.min("_i").alias("_first")))
    numbered = placed.join(first, column)
    return numbered.select(column, level, (F.col("_i") - F.col("_first") + 1).alias("idx"))


def bucket_digits(n: int) -> int:
    """Leading hex digits that cut ``n`` digests into buckets of ``_BUCKET_ROWS`` or fewer."""
    digits = 2
    while _BUCKET_ROWS * 16**digits < n:
        digits += 1
    return digits


def with_hash_index(
    df: DataFrame, key: str, seed: int, name: str = "row_index", n: int | None = None
) -> DataFrame:
    """1-based position in the digest order of a unique key; ``n`` is the number of rows.

    Digests are uniform, so their leading digits make even buckets; bucket sizes give
    the offsets and rows are numbered inside their bucket.
    """
    keyed = df.withColumn("_h", hash_key(seed, F.col(key)))
    bucket = F.substring("_h", 1, bucket_digits(df.count() if n is None else n))
    before = (
        keyed.groupBy(bucket.alias("_p"))
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    # a row per bucket
    joined = keyed.withColumn("_p", bucket).join(F.broadcast(before), "_p")
    return joined.withColumn(name, F.col("_before") + inside).drop("_p", "_h", "_before")


def cut_fold(index: Column, n: Column, k: int) -> Column:
    """Fold of position ``index`` among ``n`` when 1..n is cut into k equally wide intervals."""
    step = F.greatest(n - 1, F.lit(1))
    ceiling = F.call_function("div", (index - 1) * k + step - 1, step)  # whole numbers only
    return F.greatest(F.lit(1), ceiling).cast("int")


def with_fold(
    df: DataFrame, k: int, n: Column | None = None, index: str = "row_index", name: str = "fold"
) -> DataFrame:
    """Contiguous folds over an existing row index; ``n`` is the number of rows."""
    n = df.agg(F.count("*")).scalar() if n is None else n
    return df.withColumn(name, cut_fold(F.col(index), n, k))


def hash_folds(ids: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """Distinct ids permuted by their digest and cut into k contiguous folds."""
    spine = ids.select(key).distinct()
    n = spine.count()
    return with_fold(with_hash_index(spine, key, seed, n=n), k, F.lit(n))
