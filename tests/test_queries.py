"""Every query with SQL gives DuckDB's rows on the small tables, where those are present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerframe.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


def test_entry_lists_all():
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
