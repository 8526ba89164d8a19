"""Column selection by name."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


def starting_with(df: DataFrame, *prefixes: str) -> list[str]:
    wanted = tuple(p.lower() for p in prefixes)
    return [c for c in df.columns if c.lower().startswith(wanted)]


def ending_with(df: DataFrame, *suffixes: str) -> list[str]:
    wanted = tuple(s.lower() for s in suffixes)
    return [c for c in df.columns if c.lower().endswith(wanted)]


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def relocate(df: DataFrame, *first: str) -> DataFrame:
    rest = [c for c in df.columns if c not in first]
    return df.select(*first, *rest)
