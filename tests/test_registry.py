"""Every registered query with a SQL counterpart returns the same rows."""

import math

import duckdb
import pytest

import __spark_entry__ as registry
from conftest import SF

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def same(left, right):
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, rel_tol=1e-9, abs_tol=2e-6)
    return left == right


@pytest.mark.parametrize("name", registry.core_oracle_sql())
def test_query_equals_sql(spark, sql, name):
    frame = registry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    result = sql.execute(registry.core_oracle_sql()[name])
    columns = [column[0] for column in result.description]
    assert sorted(columns) == names
    order = [columns.index(column) for column in names]
    expected = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=str)
    got = sorted((tuple(row[column] for column in names) for row in frame.collect()), key=str)
    assert len(got) == len(expected)
    assert all(same(a, b) for left, right in zip(got, expected, strict=True) for a, b in zip(left, right, strict=True))


def test_entry_and_keys(spark):
    assert registry.entry(spark).columns == ["label", "n_train", "n_test"]
    assert set(registry.oracle_sql()) <= set(registry.queries())
    fits = {"protocol_scores_logistic", "protocol_scores_forest", "scaler_only_delta", "leakage_impact"}
    assert set(registry.core_queries()) - set(registry.core_oracle_sql()) == fits
