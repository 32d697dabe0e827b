"""Every query with SQL gives the rows of its SQL over the smallest tables."""

import math

import duckdb
import pytest

from levelforge import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    expected = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(expected.columns, expected.fetchall())


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0


def test_entry_imports_without_the_llm_folders():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
