"""All registered queries, by section."""

from remitlens.catalog import (  # noqa: F401
    aggregates,
    joins,
    missing,
    models,
    projections,
    reshape,
    scalars,
    sources,
)
from remitlens.catalog.registry import QUERIES, callable_for

__all__ = ["QUERIES", "callable_for"]
