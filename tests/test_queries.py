"""Every registered query with SQL, next to DuckDB: on the given tables and on skewed ones."""

import duckdb
import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

WITH_SQL = sorted(oracle_sql())

# Queries in which rows meet by key, value or order; the others work row by row.
MEETING = sorted(
    n for n in WITH_SQL
    if n.startswith(("profile", "last_diff", "gap", "tenure", "training_profiles", "label", "chunk", "stack", "fold",
                     "holdout", "rank", "top", "weighted", "encode", "blend_grid", "blend_objective"))
)

# Their operators are tested in test_models; these show that they run over the given tables.
MODEL_QUERIES = ["blend_apply", "meta_feature_apply", "neural_member", "stacking"]


@pytest.fixture(scope="module")
def skewed_tables(tmp_path_factory):
    """The small tables with a third of the rows on one key and a third on one value."""
    folder = tmp_path_factory.mktemp("skewed")
    source = "/root/testdata/sf0.001"
    con = duckdb.connect()
    changes = {
        "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey, "
        "CASE WHEN o_orderkey % 3 = 1 THEN 250000.0 ELSE o_totalprice END AS o_totalprice)",
        "lineitem": "* REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey)",
        "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_id END AS user_id)",
        "customer": "*",
        "documents": "* REPLACE (CASE WHEN doc_id % 3 = 0 THEN 500 ELSE n_chars END AS n_chars)",
        "labels": "*",
    }
    for name, columns in changes.items():
        con.execute(f"COPY (SELECT {columns} FROM '{source}/{name}.parquet') TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, sf_small, name):
    rows, diff = differences(spark, connect(sf_small), queries()[name], oracle_sql()[name], sf_small)
    assert rows > 0
    assert diff == []


@pytest.mark.parametrize("name", MEETING)
def test_query_equals_sql_under_skew(spark, skewed_tables, low_floor, name):
    rows, diff = differences(spark, connect(skewed_tables), queries()[name], oracle_sql()[name], skewed_tables)
    assert rows > 0
    assert diff == []


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_query_runs(spark, sf_small, name):
    assert queries()[name](spark, sf_small).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
