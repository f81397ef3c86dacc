"""Every registered query against its SQL, by value, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from jabcheck.checks.oracle import ORACLE
from jabcheck.checks.queries import QUERIES

TABLES = ("customer", "orders", "lineitem", "part")


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_dir}/{name}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    return value


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, small_dir, name):
    frame = QUERIES[name](spark, small_dir)
    columns = sorted(frame.columns)
    ours = [tuple(map(plain, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(duck.sql(ORACLE[name]).columns) == columns
    selected = ", ".join(f'"{c}"' for c in columns)
    theirs = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {selected} FROM ({ORACLE[name]})").fetchall()]
    assert len(ours) > 0
    assert Counter(ours) == Counter(theirs)
