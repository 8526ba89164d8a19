"""Column expressions: labels, text, dates, null-aware aggregates, ratios, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def yes_no(c: Column) -> Column:
    """Yes is 1, No is 0, anything else null."""
    return F.when(c == "Yes", 1).when(c == "No", 0)


def any_known(flag: Column) -> Column:
    """Three-valued any over 0/1: 1 if one is set, null if undecided, else 0."""
    return F.when(F.max(flag) == 1, 1).when(F.count(flag) == F.count(F.lit(1)), 0)


def strict_sum(c: Column) -> Column:
    """Sum that is null as soon as one input is null."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def count_present(columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for name in columns:
        total = total + F.col(name).isNotNull().cast("int")
    return total


def split_parts(c: Column, names: Sequence[str], pattern: str = r"\|") -> list[Column]:
    """Leading parts of delimited text; missing parts are null, extra parts dropped."""
    parts = F.split(c, pattern)
    return [F.get(parts, i).alias(name) for i, name in enumerate(names)]


def count_parts(c: Column, pattern: str = r"\|") -> Column:
    return F.regexp_count(c, F.lit(pattern)) + 1


def parse_us_date(c: Column) -> Column:
    """Month/day/year text to a date, null when it is not one."""
    return F.try_to_date(c, "M/d/yyyy")


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double, null when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat_ws(" ", F.lit(prefix), c.cast("string"))


def hash_key(seed: int | Column, c: Column) -> Column:
    """Hex digest of ``seed:value``, the reproducible random order of a key."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), c.cast("string")))


def hash_bucket(seed: int | Column, c: Column) -> Column:
    """First 60 bits of the digest as a non-negative bigint."""
    return F.conv(F.substring(hash_key(seed, c), 1, 15), 16, 10).cast("bigint")


HASH_RANGE = 1 << 60


def hash_below(seed: int | Column, c: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return hash_bucket(seed, c) < int(share * HASH_RANGE)
