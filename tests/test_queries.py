"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from sluice.plans import catalog
from sluice.sources import derived

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("nation", "customer", "orders", "lineitem", "events")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def views(spark):
    with derived.kept(spark, DATA):
        yield


def plain(rows):
    return sorted(tuple("NULL" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = plain(tuple(r) for r in found.select(columns).collect())
    assert rows
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == columns
        kinds = dict(zip(want.columns, map(str, want.types), strict=True))
        assert {c: KINDS.get(t, t) for c, t in found.dtypes} == kinds
        assert rows == plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
