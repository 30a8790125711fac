"""Every registered query against its SQL in DuckDB, on the whole sf0.001 tables."""

import math

import duckdb
import pytest

from tidegate.plans import all_oracles, all_queries

from conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_same_rows_as_sql(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(all_oracles()[name])
    assert sorted(want.columns) == columns
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in at] for r in want.fetchall())
    assert got


QUICK = ["o43_local_training", "o44_federated_run", "o46_knn_flows", "o47_decision_tree", "o56_parameter_importance"]


@pytest.mark.parametrize("name", QUICK)
def test_rows_without_sql_twin(spark, name):
    assert all_queries()[name](spark, SF).count() > 0


def test_every_oracle_has_its_query():
    assert set(all_oracles()) <= set(all_queries())
