from __future__ import annotations

from pyspark.sql import functions as F

from contexture.operators import history, marts
from contexture.plans import events_roles as roles
from tests.conftest import TESTDATA
from tests.helpers import at, incidents, joined, observed, tuples


def test_rate_by_context(spark):
    seen = observed(
        spark,
        [(0, "Rain", 1), (60, "Rain", 1), (60, "Rain", 1), (120, "Snow", 1), (180, None, 1)],
    )
    rows = joined(
        spark,
        [
            ("A", 0, "Minor", "Rain", 1),
            ("A", 60, "Minor", "Rain", 1),
            ("B", 0, "Minor", "Rain", 1),
            ("C", 0, "Minor", "Rain", 1),
            ("D", 0, "Minor", "Fog", 1),
        ],
    )
    rates = {r[0]: r[1] for r in marts.rate_by_context(seen, rows).collect()}
    assert rates == {"Rain": 1.5, "Snow": 0.0, None: 0.0}


def test_rate_without_instants_is_null(spark):
    seen = observed(spark, [(None, "Rain", 1)])
    rows = joined(spark, [("A", 0, "Minor", "Rain", 1)])
    assert marts.rate_by_context(seen, rows).first()["incident_rate"] is None


def test_rate_equals_the_fan_out_form(spark):
    source = roles.events(spark, str(TESTDATA / "sf0.01"))
    seen, rows = roles.observation_table(source), roles.joined_table(source)
    fan_out = (
        seen.alias("o")
        .join(rows.alias("j"), F.expr("o.weather_desc = j.weather_desc"), "left")
        .groupBy("o.weather_desc")
        .agg((F.countDistinct("t_id") / F.countDistinct("w_timestamp")).alias("r"))
    )
    assert tuples(marts.rate_by_context(seen, rows)) == tuples(fan_out)


def test_bands(spark):
    metres = [1999, 2000, 4999, 5000, 9999, 10000, None]
    seen = observed(spark, [(60 * i, "Rain", m) for i, m in enumerate(metres)])
    rows = joined(spark, [("A", 0, "Minor", "Rain", 100), ("B", 0, "Minor", "Rain", 3000)])
    counts = {r["vis_range"]: r["minute_count"] for r in marts.minutes_by_bucket(seen).collect()}
    assert counts == {
        "Poor (0-2km)": 1,
        "Moderate (2-5km)": 2,
        "Good (5-10km)": 2,
        "Clear (10km+)": 1,
    }
    rates = [tuple(r) for r in marts.rate_by_bucket(seen, rows).collect()]
    assert rates == [
        ("Poor (0-2km)", 0, 1.0),
        ("Moderate (2-5km)", 1, 0.5),
        ("Good (5-10km)", 2, 0.0),
        ("Clear (10km+)", 3, 0.0),
    ]


def test_band_counts_sum_to_the_input(spark):
    source = roles.events(spark, str(TESTDATA / "sf0.01"))
    seen = roles.observation_table(source)
    total = marts.minutes_by_bucket(seen).agg(F.sum("minute_count")).first()[0]
    assert total == seen.filter("visibility IS NOT NULL").count()


def test_severity(spark):
    rows = joined(
        spark,
        [
            ("A", 0, "Minor", "Rain", 1),
            ("A", 60, "Minor", "Rain", 1),
            ("B", 0, "Major", "Rain", 1),
            ("C", 0, "Minor", "Fog", 1),
            ("D", 0, None, "Fog", 1),
            ("E", 0, "Minor", None, 1),
        ],
    )
    assert [tuple(r) for r in marts.severity_by_context(rows).collect()] == [
        ("Fog", "Minor", 1),
        ("Rain", "Major", 1),
        ("Rain", "Minor", 1),
    ]
    pivot = marts.severity_pivot(rows)
    assert pivot.columns == [
        "weather_desc",
        "Major",
        "Minor",
        "Moderate",
        "Undefined",
        "Unknown",
        "Other",
    ]
    assert tuples(pivot) == [("Fog", 0, 1, 0, 0, 0, 0), ("Rain", 1, 1, 0, 0, 0, 0)]


def test_unlisted_severities_are_added_up(spark):
    rows = joined(
        spark,
        [
            ("A", 0, "Severe", "Rain", 1),
            ("A", 1, "Critical", "Rain", 1),
            ("B", 0, "Critical", "Fog", 1),
            ("C", 0, "Other", "Fog", 1),
        ],
    )
    pivot = {r["weather_desc"]: r for r in marts.severity_pivot(rows).collect()}
    assert pivot["Rain"]["Other"] == 2 and pivot["Fog"]["Other"] == 2
    assert pivot["Rain"]["Major"] == 0


def test_counts_with_and_without_null(spark):
    rows = joined(spark, [("A", 0, "Minor", "Rain", 1), ("B", 0, "Minor", None, 1)])
    assert tuples(marts.count_by_context(rows)) == [("Rain", 1)]
    kept = {r[0]: r[1] for r in marts.count_by_context(rows, keep_null=True).collect()}
    assert kept == {"Rain": 1, None: 1}


def test_history_keeps_the_earliest(spark):
    rows = joined(
        spark,
        [
            ("A", 60, "Minor", "Rain", 1),
            ("A", 0, "Major", "Snow", 1),
            ("B", 30, "Minor", "Rain", 1),
            ("C", 90, "Minor", "Rain", 1),
        ],
    )
    listing = history.history(rows, limit=2)
    assert [(r["t_id"], r["weather_desc"]) for r in listing.collect()] == [
        ("C", "Rain"),
        ("B", "Rain"),
    ]
    first = {r["t_id"]: r["t_severity"] for r in history.first_per_key(rows).collect()}
    assert first == {"A": "Major", "B": "Minor", "C": "Minor"}
    assert [r["t_id"] for r in history.newest_first(rows).collect()] == ["C", "A", "B", "A"]


def test_listing_puts_missing_times_last(spark):
    rows = incidents(spark, [("A", None), ("B", 1), ("C", 2)])
    assert [r["t_id"] for r in history.latest(rows, 3).collect()] == ["C", "B", "A"]


def test_scans_read_needed_columns_only(spark, folder, check_plan):
    path = folder("joined")
    joined(spark, [("A", 0, "Minor", "Rain", 1)]).write.parquet(path)
    plan = check_plan(marts.severity_by_context(spark.read.parquet(path)))
    assert "ReadSchema: struct<t_id:string,t_severity:string,weather_desc:string>" in plan
    assert "IsNotNull(t_severity)" in plan and "IsNotNull(weather_desc)" in plan


def test_limits_reach_the_tasks(spark, folder, check_plan):
    path = folder("joined")
    joined(spark, [("A", 0, "Minor", "Rain", 1)]).write.parquet(path)
    table = spark.read.parquet(path)
    assert "TakeOrderedAndProject" in check_plan(history.history(table, 10))
    assert "WindowGroupLimit" in check_plan(history.first_per_key(table))


def test_times_are_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.createDataFrame([(at(0),)], "t timestamp").select(
        F.unix_seconds("t")
    ).first()[0] == int(at(0).timestamp())
