"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from textloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if not hasattr(value, "hour") else value.isoformat()
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, db, name):
    out = catalogue.queries()[name](spark, DATA)
    result = db.sql(catalogue.oracle_sql()[name])
    columns = sorted(out.columns)
    assert columns == sorted(result.columns)
    order = [result.columns.index(c) for c in columns]
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in out.collect())
    assert got == sorted(str(tuple(plain(r[i]) for i in order)) for r in result.fetchall())


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
