"""Every registered query against its SQL twin on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from moltraj.plans.queries import REGISTERED
from tools.compare import compare

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"topology_split_listed", "tica_embedding", "tica_scores", "kmeans_labels", "effective_rank"}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_only_named_queries_have_no_twin():
    assert set(REGISTERED) - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(REGISTERED) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query(spark, tables, name):
    result, _ = compare(spark, tables, name, contract.queries()[name], contract.oracle_sql().get(name), SF)
    assert result.startswith(("ok", "rows-only")) and "TYPES" not in result, result
    assert name not in ROWS_ONLY or not result.endswith(" 0")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_a_last_value_of_zero_is_infinitely_far(spark, folder):
    """the depth of zero is minus infinity; such a run comes first, as in the twin."""
    connection = duckdb.connect()
    connection.sql(
        f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i % 9 AS user_id, 'view' AS event_type, "
        f"CASE WHEN i IN (20, 24) THEN 0.0e0 ELSE i + 0.25e0 END AS value, '' AS props FROM range(27) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)"
    )
    connection.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    name = "rank_distance_to_known"
    result, _ = compare(spark, connection, name, contract.queries()[name], contract.oracle_sql()[name], folder)
    assert result == "ok 9", result
