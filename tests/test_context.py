from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from contexture.operators.context import (
    JOINED_COLUMNS,
    context_join,
    nearest_observation,
)
from contexture.operators.dedup import distinct_incidents, distinct_observations
from tests.helpers import at, incidents, observations


def labels(df):
    """{(id, seconds): label} of a joined frame."""
    rows = df.select("t_id", F.unix_seconds("t_start"), "weather_desc").collect()
    return {(r[0], r[1] - int(at(0).timestamp())): r[2] for r in rows}


def test_nearest_of_two_in_a_minute(spark):
    result = context_join(
        incidents(spark, [("A", 40)]),
        observations(spark, [(0, "Rain"), (50, "Clear")]),
    )
    assert labels(result) == {("A", 40): "Clear"}


def test_tie_goes_to_the_earlier(spark):
    result = context_join(
        incidents(spark, [("A", 30)]),
        observations(spark, [(20, "Snow"), (40, "Clear")]),
    )
    assert labels(result) == {("A", 30): "Snow"}


def test_tie_at_one_instant_goes_by_columns_nulls_last(spark):
    result = context_join(
        incidents(spark, [("A", 30)]),
        observations(
            spark,
            [
                (30, None, 1, 0.0),
                (30, "Rain", None, 0.0),
                (30, "Rain", 7, None),
                (30, "Rain", 7, 2.0),
                (30, "Snow", 1, 0.0),
            ],
        ),
    )
    row = result.first()
    assert (row["weather_desc"], row["visibility"], row["rain"]) == ("Rain", 7, 2.0)


def test_minute_edge(spark):
    rows = incidents(spark, [("A", 59)])
    seen = observations(spark, [(61, "Rain")])
    assert context_join(rows, seen).count() == 0
    assert labels(context_join(rows, seen, bucket_seconds=None)) == {("A", 59): "Rain"}


def test_tolerance_is_inclusive_and_crosses_buckets(spark):
    rows = incidents(spark, [("A", 1000), ("B", 1001), ("C", -1000)])
    seen = observations(spark, [(700, "Rain"), (-700, "Snow")])
    result = context_join(rows, seen, bucket_seconds=None)
    assert labels(result) == {("A", 1000): "Rain", ("C", -1000): "Snow"}


def test_nearest_with_a_null_label_drops_the_incident(spark):
    rows = incidents(spark, [("A", 30)])
    seen = observations(spark, [(10, "Rain"), (31, None)])
    assert context_join(rows, seen).count() == 0
    assert labels(context_join(rows, seen, required=None)) == {("A", 30): None}


def test_repeated_polls_and_new_starts(spark):
    rows = incidents(spark, [("A", 5), ("A", 5), ("A", 70), ("B", None)])
    seen = observations(spark, [(0, "Rain"), (65, "Snow"), (None, "Fog")])
    result = context_join(rows, seen)
    assert labels(result) == {("A", 5): "Rain", ("A", 70): "Snow"}
    assert result.count() == 2


def test_distinct_incidents_pick_is_total(spark):
    rows = [
        ("A", 1, "Ice", "Minor"),
        ("A", 1, "Accident", None),
        ("A", 1, "Accident", "Major"),
    ]
    for order in (rows, rows[::-1]):
        row = distinct_incidents(incidents(spark, order)).first()
        assert (row["t_type"], row["t_severity"]) == ("Accident", "Major")


def test_distinct_observations(spark):
    seen = observations(spark, [(0, "Snow"), (0, "Rain"), (0, None), (None, "Fog")])
    assert [r["weather_desc"] for r in distinct_observations(seen).collect()] == ["Rain"]


def brute_force(incident_rows, seen, bucket, tolerance):
    base = int(at(0).timestamp())

    def place(value):
        return (value is None, value if value is not None else 0)

    def same_bucket(one, other):
        return bucket is None or (base + one) // bucket == (base + other) // bucket

    out = {}
    for name, t in incident_rows:
        reach = [
            o
            for o in seen
            if abs(o[0] - t) <= tolerance and same_bucket(o[0], t)
        ]
        if not reach:
            continue
        best = min(
            reach,
            key=lambda o: (
                abs(o[0] - t),
                o[0],
                (o[1] is None, o[1] or ""),
                place(o[2]),
                place(o[3]),
            ),
        )
        out[(name, t)] = best[1:]
    return out


@pytest.mark.parametrize("slot", [None, 5])
@pytest.mark.parametrize("bucket", [60, 7, 1000, None])
def test_join_equals_brute_force(spark, bucket, slot):
    rng = random.Random(f"{bucket} {slot}")
    tolerance = 40
    incident_rows = [
        (f"I{rng.randrange(20)}", rng.randrange(-900, 900)) for _ in range(300)
    ]
    seen = [
        (
            rng.randrange(-900, 900),
            rng.choice(["Rain", "Clear", None]),
            rng.choice([1, 2, None]),
            rng.choice([0.0, 0.5, None]),
        )
        for _ in range(60)
    ]
    result = context_join(
        incidents(spark, incident_rows),
        observations(spark, seen),
        bucket_seconds=bucket,
        tolerance_seconds=tolerance,
        required=None,
        slot_seconds=slot,
    )
    rows = result.select(
        "t_id", F.unix_seconds("t_start"), "weather_desc", "visibility", "rain"
    ).collect()
    base = int(at(0).timestamp())
    got = {(r[0], r[1] - base): tuple(r[2:]) for r in rows}
    assert len(rows) == len(got)
    assert got == brute_force(incident_rows, seen, bucket, tolerance)


def test_empty_sides(spark):
    rows, seen = incidents(spark, [("A", 1)]), observations(spark, [(0, "Rain")])
    assert context_join(rows.limit(0), seen).count() == 0
    assert context_join(rows, seen.limit(0)).count() == 0
    assert context_join(rows, seen.limit(0)).columns == list(JOINED_COLUMNS)


def test_other_columns_and_names(spark):
    """Any columns may ride along and serve as context."""
    rows = incidents(spark, [("A", 1)]).selectExpr(
        "t_id", "t_start", "t_type AS `road type`"
    )
    seen = observations(spark, [(0, "Rain")]).selectExpr(
        "w_timestamp", "weather_desc AS `the label`"
    )
    result = context_join(rows, seen, context=["the label"], required="the label")
    assert result.columns == ["t_id", "t_start", "road type", "the label"]
    assert result.first()["the label"] == "Rain"


@pytest.mark.parametrize("slot", [None, 1, 10])
def test_sub_second_times(spark, slot):
    rows = incidents(spark, [("A", 30.25), ("B", 39.5), ("C", 59.9), ("D", 0.0)])
    seen = observations(spark, [(30.0, "Rain"), (30.4, "Snow"), (45.5, "Fog")])
    result = context_join(rows, seen, slot_seconds=slot)
    assert {r["t_id"]: r["weather_desc"] for r in result.collect()} == {
        "A": "Snow",
        "B": "Fog",
        "C": "Fog",
        "D": "Rain",
    }


def test_no_pairs_are_formed(spark, check_plan):
    """A busy minute: rows entering each join are bounded by the two inputs."""
    crowd = spark.range(20000).selectExpr(
        "concat('I', id) AS t_id",
        "'Accident' AS t_type",
        "'Minor' AS t_severity",
        "timestamp_seconds(1709251200 + id % 60) AS t_start",
    )
    seen = spark.range(20000).selectExpr(
        "timestamp_seconds(1709251200 + id % 60) AS w_timestamp",
        "concat('L', id % 7) AS weather_desc",
        "CAST(id AS INT) AS visibility",
        "0.0D AS rain",
    )
    answer = nearest_observation(crowd, seen)
    assert answer.count() == 60
    result = context_join(crowd, seen)
    assert result.count() == 20000
    plan = check_plan(result)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_start_time_is_split(spark, check_plan):
    """A third of all incidents at one instant: the join is split by size."""
    session = spark.newSession()
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        session.conf.set(key, value)
    crowd = session.range(0, 90000, 1, 8).selectExpr(
        "concat('I', id) AS t_id",
        "concat('type ', hash(id)) AS t_type",
        "concat('severity ', hash(id, 1)) AS t_severity",
        "timestamp_seconds(IF(id % 3 = 0, 1709251200, 1709251200 + id % 3000)) AS t_start",
    )
    seen = session.range(0, 3000).selectExpr(
        "timestamp_seconds(1709251200 + id) AS w_timestamp",
        "concat('L', id % 7) AS weather_desc",
        "CAST(id AS INT) AS visibility",
        "0.0D AS rain",
    )
    result = context_join(crowd, seen)
    rows = result.collect()
    assert len(rows) == 90000
    assert "skew=true" in check_plan(result)
