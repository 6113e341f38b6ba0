"""Every driver query against its SQL, and the plans that matter."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
SQL = {name: sql for family in entry.FAMILIES for name, sql in family.SQL.items()}
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.EXTRA_QUERIES}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(SF, name)}.parquet')")
    return con


def plain(value):
    return "NULL" if value is None or (isinstance(value, float) and math.isnan(value)) else repr(value)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name not in SQL:
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} == {"train", "valid", "test"}


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fmt_text_documents", "fmt_chat_columns", "split_exact", "eval_samples_text", "split_normalise"])
def test_row_wise_queries_move_nothing(spark, sf_dir, name):
    assert "Exchange" not in plan(spark, sf_dir, name)


def test_columns_are_pruned(spark, sf_dir):
    assert "ReadSchema: struct<doc_id:bigint>" in plan(spark, sf_dir, "split_exact")
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(spark, sf_dir, "split_normalise")


def test_curves_are_filtered_in_the_scan(spark, sf_dir):
    assert "In(event_type, [click,view])" in plan(spark, sf_dir, "best_val_checkpoint")


@pytest.mark.parametrize("name", ["pre_overfit_knee", "train_loss_asof", "confusion_matrix", "eval_summary", "checkpoint_strategy"])
def test_no_cartesian_products(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
