"""Every query of the package that SQL can express, against its SQL."""

import math
import os

import duckdb
import pytest

from tests.conftest import SF
from tuneprep.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(SF, name)}.parquet')")
    return con


def plain(value):
    return "NULL" if value is None or (isinstance(value, float) and math.isnan(value)) else repr(value)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_is_its_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == expected and rows
