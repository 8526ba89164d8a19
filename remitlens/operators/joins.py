"""Joins between the payment fact and one-row-per-key tables, safe under skew.

A key may hold a third of the fact. Small right sides are broadcast by Spark itself,
which checks their size. Otherwise the rows of hot keys are spread over as many salts
as keep a task at ``ROWS_PER_TASK`` rows of one key, and the matching right rows are
repeated once per salt.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.session import fits_broadcast, materialize


ROWS_PER_TASK = 1_000_000  # rows of one key a task may be given


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of more than ``ROWS_PER_TASK`` rows, with the number of salts each needs.

    The limit does not depend on the number of partitions. One scan finds the keys, of
    which there are at most one per ``ROWS_PER_TASK`` rows of the data.
    """
    sized = df.groupBy(*on).agg(F.count("*").alias("_n"))
    salts = F.ceil(F.col("_n") / ROWS_PER_TASK)
    hot = sized.filter(F.col("_n") > ROWS_PER_TASK)
    return hot.select(*on, salts.cast("int").alias("_salts"))


def _join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool
) -> DataFrame:
    """Equi-join keeping one copy of the keys; ``null_safe`` lets null keys match."""
    if not null_safe:
        return left.join(right, list(on), how)
    other = {c: f"_right_{c}" for c in on}
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(renamed)) for c, renamed in other.items()]
    )
    return left.join(right.withColumnsRenamed(other), same, how).drop(*other.values())


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    spread_by: Sequence[str] | str,
    how: str = "left",
    salted: bool | None = None,
    keys_from: DataFrame | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join many rows per key (``left``) to one row per key (``right``).

    ``how`` is left, inner, left_semi or left_anti. ``spread_by`` names left columns
    that differ between rows of one key. ``keys_from`` is a cheaper table with the same
    key frequencies as ``left``, such as the fact before other joins. Null keys match
    nothing unless ``null_safe`` is set.
    """
    on = [on] if isinstance(on, str) else list(on)
    spread_by = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    if salted is None:
        salted = not fits_broadcast(right)
    if not salted:
        return _join(left, right, on, how, null_safe)
    # pinned once, so both sides use the same salts; a row per ROWS_PER_TASK rows at most
    hot = materialize(hot_keys(left if keys_from is None else keys_from, on), "hot_keys")
    hot = F.broadcast(hot)
    spread = F.xxhash64(*spread_by)
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
    if not null_safe:
        # rows with a null key find no partner wherever they are, so they spread too
        null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
        salt = salt.when(null_key, F.pmod(spread, F.lit(shuffle_partitions(left))))
    many = _join(left, hot, on, "left", null_safe)
    many = many.withColumn("_salt", salt.otherwise(0).cast("int")).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    one = _join(right, hot, on, "left", null_safe).withColumn("_salt", copies).drop("_salts")
    return _join(many, one, [*on, "_salt"], how, null_safe).drop("_salt")


def join_natural(
    left: DataFrame,
    right: DataFrame,
    spread_by: Sequence[str] | str,
    how: str = "left",
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Join on all columns both sides share."""
    on = [c for c in left.columns if c in set(right.columns)]
    return join_skewed(left, right, on, spread_by, how, keys_from=keys_from)


def join_keeping_dimension(
    dim: DataFrame, fact: DataFrame, on: str, spread_by: Sequence[str] | str
) -> DataFrame:
    """Every fact row with its dimension row, plus dimension rows that have no fact.

    The left join from the dimension, arranged so that the fact stays the probing side.
    """
    matched = join_skewed(fact, dim, on, spread_by, "inner")
    idle = dim.join(fact.select(on).distinct(), on, "left_anti")
    return matched.unionByName(idle, allowMissingColumns=True)
