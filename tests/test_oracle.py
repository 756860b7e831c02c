"""Every query against its DuckDB form on the smallest tables; those without one must run."""

import math

import duckdb
import pytest

from docspark.plans import queries as fields
from docspark.plans import records, stores
from docspark.plans.adapters import TABLES

QUERIES = fields.QUERIES | records.QUERIES | stores.QUERIES
SQL = fields.ORACLE_SQL | records.ORACLE_SQL | stores.ORACLE_SQL


def cell(x):
    if isinstance(x, bytearray | bytes):
        return bytes(x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, list | tuple):
        return tuple(cell(v) for v in x)
    return round(float(x), 6) if type(x).__name__ == "Decimal" else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(cell(row[i]) for i in order)) for row in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())
