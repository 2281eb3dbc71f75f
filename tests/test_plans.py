"""What the physical plans of the named queries must and must not hold."""

from __future__ import annotations

import pytest

from contexture.operators.context import context_join
from contexture.plans import events_roles as roles
from contexture.plans import queries
from contexture.sources.topics import INCIDENT_TOPIC, WEATHER_TOPIC, FolderTopics
from contexture.streaming import pipeline
from tests.conftest import TESTDATA

SF_DIR = str(TESTDATA / "sf0.001")
LAZY = [
    name
    for name in queries.QUERIES
    if not name.startswith(("stream_", "topic_", "live_", "sql_", "pipeline_", "publish_"))
]
# These write tables first and read those, like the ones left out above.
OF_TABLES = [
    "severity_pivot_open",
    "rate_incremental",
    "rate_by_bucket_incremental",
    "severity_pivot_incremental",
    "history_limited",
    "joined_by_ids",
    "bounding_box_cells",
    "bounding_box_date_line",
    "late_rows_replayed",
    "quarantined",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_and_no_python(spark, check_plan, name):
    plan = check_plan(queries.QUERIES[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "NestedLoop", "Python", "MapInArrow"):
        assert unwanted not in plan


@pytest.mark.parametrize("name", [n for n in LAZY if n not in OF_TABLES])
def test_event_filters_reach_the_scan(spark, check_plan, name):
    plan = check_plan(queries.QUERIES[name](spark, SF_DIR))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans
    if name in ("code_labels", "bounding_box", "minute_bucket"):
        return
    pushed = [scan.split("PushedFilters: ")[1].split("ReadSchema")[0] for scan in scans]
    assert all("In(event_type" in filters for filters in pushed)


@pytest.mark.parametrize("name", OF_TABLES)
def test_queries_of_tables_do_not_go_back_to_the_events(spark, name):
    files = queries.QUERIES[name](spark, SF_DIR).inputFiles()
    assert files and not any("events.parquet" in file for file in files)
    if name.endswith("_incremental"):
        # Counts of the ledgers' parts, and no row of the tables.
        assert all("/ledgers/" in file and "/counts/" in file for file in files)


@pytest.mark.parametrize("match", ["first", "nearest"])
def test_default_streams_run_no_python(spark, tmp_path, match):
    topics = FolderTopics(str(tmp_path))
    for topic in (WEATHER_TOPIC, INCIDENT_TOPIC):
        (tmp_path / topic).mkdir()
    config = pipeline.PipelineConfig("j", "o", "c", match=match)
    for rows in (
        pipeline.joined_stream(spark, topics, config),
        pipeline.observations_stream(spark, topics, config),
    ):
        plan = rows._jdf.queryExecution().analyzed().toString()
        assert "Python" not in plan and "MapInArrow" not in plan


def test_join_sides_share_one_reduction(spark, check_plan):
    """Observations are reduced once for the join and for the rates."""
    df = queries.rate_by_context(spark, SF_DIR)
    df.collect()
    assert "ReusedExchange" in check_plan(df)


def test_join_sits_on_its_shuffles(spark, check_plan):
    """Skew handling needs sort-merge join over sort over shuffle."""
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    source = roles.events(session, SF_DIR)
    plan = check_plan(context_join(roles.incidents(source), roles.observations(source)))
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    join = next(i for i, line in enumerate(lines) if line.startswith("SortMergeJoin"))
    assert lines[join + 1].startswith("Sort [t_start")
    assert lines[join + 2].startswith("Exchange hashpartitioning(t_start")


def test_counts_leave_unused_columns_unread(spark, check_plan):
    plan = check_plan(queries.batch_row_count(spark, SF_DIR))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    for scan in scans:
        if "In(event_type, [error" in scan:
            assert "value" not in scan and "props" not in scan
