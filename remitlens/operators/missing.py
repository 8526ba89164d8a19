"""Null handling and completeness profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = "DUMMY"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def fill_sentinel(df: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """Null text becomes the sentinel; other types keep their nulls."""
    return df.na.fill(sentinel, subset=string_columns(df))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of filled values per column, in one pass."""
    columns = list(columns or df.columns)
    rates = df.agg(
        *[(F.count(c).cast("double") / F.count(F.lit(1))).alias(c) for c in columns]
    )
    return rates.unpivot([], columns, "column_name", "complete_rate")
