"""Every named query against its SQL, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from contexture.plans import oracle, queries
from tests.compare import oracle_connection, spark_rows, sql_rows
from tests.conftest import TESTDATA

SF_DIR = TESTDATA / "sf0.01"
# Those of optional parts are tested with these.
QUERIES = queries.QUERIES
ORACLE = oracle.ORACLE


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, str(SF_DIR)))
    expected_columns, expected = sql_rows(con, ORACLE[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The small tables with ``events`` as a folder of files in mixed order."""
    base = tmp_path_factory.mktemp("many")
    events = spark.read.parquet(str(TESTDATA / "sf0.001" / "events.parquet"))
    events.repartition(5).write.parquet(str(base / "events.parquet"))
    return base


@pytest.mark.parametrize(
    "name",
    [
        "rate_by_context",
        "context_join_tolerance",
        "first_per_key_history",
        "stream_dedup",
        "stream_context_join_nearest",
        "pipeline_tables",
    ],
)
def test_layout_of_files_does_not_matter(spark, many_files, name):
    con = oracle_connection(TESTDATA / "sf0.001")
    assert spark_rows(QUERIES[name](spark, str(many_files))) == sql_rows(con, ORACLE[name])


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["weather_desc", "incident_rate"]
    assert df.count() == 6
