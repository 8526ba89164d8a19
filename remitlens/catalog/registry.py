"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from remitlens.functions import bins
from remitlens.sources.fixtures import Tables, oracle_ctes


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(oracle: str | None = None, ctes: str | None = None):
    """Register a function of the tables under its name.

    ``oracle`` is the SELECT over phys, pay and comp giving the same rows; ``ctes``
    holds further WITH entries it uses.
    """

    def register(run: Callable[[Tables], DataFrame]):
        sql = None
        if oracle is not None:
            extra = f", {ctes.strip()}" if ctes else ""
            sql = f"WITH {oracle_ctes()}{extra} {oracle.strip()}"
        if run.__name__ in QUERIES:
            raise ValueError(f"query {run.__name__} is registered twice")
        QUERIES[run.__name__] = Query(run.__name__, run, sql)
        return run

    return register


def cut_sql(value: str, breaks) -> str:
    """Bin index by counting the edges passed."""
    finite = [b for b in breaks if b not in (bins.INF, -bins.INF)]
    shift = 1 if breaks[0] == -bins.INF else 0
    index = " + ".join(f"CASE WHEN {value} > {b} THEN 1 ELSE 0 END" for b in finite)
    tests = [f"{value} IS NOT NULL"]
    if breaks[0] != -bins.INF:
        tests.append(f"{value} > {breaks[0]}")
    if breaks[-1] != bins.INF:
        tests.append(f"{value} <= {breaks[-1]}")
        index = index.rsplit(" + ", 1)[0]
    return f"CAST(CASE WHEN {' AND '.join(tests)} THEN {index} + {shift} END AS INTEGER)"


def callable_for(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.run(Tables(spark, sf_dir))

    run.__name__ = entry.name
    return run
