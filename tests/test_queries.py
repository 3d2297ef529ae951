"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from textloom.plans import library_queries, library_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(library_sql()))
def test_query_equals_sql(spark, duck, name):
    got = library_queries()[name](spark, SF_DIR)
    want = duck.execute(library_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [[plain(r[c]) for c in names] for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())
