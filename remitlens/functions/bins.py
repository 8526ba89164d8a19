"""Right-closed bins and count bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf

# Bin edges.
AMOUNT_BREAKS = [0, 10, 15, 20, 30, 40, 50, 60, 70, 80, 90, 100, INF]
AMOUNT_BREAKS_WIDE = [-INF, 10, 15, 20, 30, 40, 50, 60, 70, 80, 90, 100, 500, INF]
TOTAL_BREAKS = [-INF, 500, 1000, 5000, 20000, 40000, INF]
TOTAL_BREAKS_FINE = [
    -INF, 100, 200, 400, 750, 1000, 1250, 1500, 2500, 5000, 7500, 10000,
    100000, 1000000, 10000000, INF,
]
MEAN_BREAKS = [-INF, 50, 100, 300, 1000, 5000, 10000, INF]
PERCENT_BREAKS = [0, 25, 50, 75, 100]
PERCENT_BREAKS_FINE = [0, 2.5, 5, 10, 15, 20, 30, 40, 50, 60, 70, 80, 90, 100]
PERCENT_BREAKS_FORM = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]

# Count bands, inclusive on both ends.
COUNT_BANDS = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 6), (7, 11), (12, 16), (17, 20)]
COUNT_BAND_REST = "20+"


def cut(c: Column, breaks: Sequence[float]) -> Column:
    """1-based index of the interval ``(lo, hi]`` holding the value, null outside."""
    inside = c > breaks[0] if breaks[0] != -INF else c.isNotNull()
    chosen = None
    for index, upper in enumerate(breaks[1:], start=1):
        test = inside & (c <= upper) if upper != INF else inside
        chosen = F.when(test, index) if chosen is None else chosen.when(test, index)
    return chosen


def _edge(x: float) -> str:
    return ("-Inf" if x < 0 else "Inf") if math.isinf(x) else f"{x:g}" if x < 100000 else str(int(x))


def cut_labels(breaks: Sequence[float]) -> list[str]:
    return [
        f"({_edge(lo)},{_edge(hi)}{')' if hi == INF else ']'}"
        for lo, hi in zip(breaks, breaks[1:])
    ]


def cut_label(c: Column, breaks: Sequence[float]) -> Column:
    """Text form of :func:`cut`."""
    return F.get(F.array(*map(F.lit, cut_labels(breaks))), cut(c, breaks) - 1)


def count_band(c: Column) -> Column:
    """Band of a payment count; 0, null and large counts share the last band."""
    chosen = None
    for low, high in COUNT_BANDS:
        text = str(low) if low == high else f"{low}-{high}"
        test = c.between(low, high)
        chosen = F.when(test, text) if chosen is None else chosen.when(test, text)
    return chosen.otherwise(COUNT_BAND_REST)
