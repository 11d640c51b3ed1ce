"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from galvanite.plans import queries


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted(repr(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns)) for row in result.fetchall())
    assert found == wanted


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
