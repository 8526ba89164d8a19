"""Every query with a SQL check gives the rows of that SQL on the same files."""

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
TABLES = ("customer", "orders", "supplier", "documents", "benchmark", "labels")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


def text(value):
    if value is None:
        return "~null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    place = [names.index(c) for c in df.columns]
    expected = sorted(tuple(text(r[i]) for i in place) for r in result.fetchall())
    assert sorted(tuple(map(text, r)) for r in df.collect()) == expected


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "feature", "value"]
    assert df.limit(1).count() == 1
