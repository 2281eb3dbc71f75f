from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from contexture import schemas
from contexture.functions.records import decode, encode
from contexture.operators import normalize
from tests.helpers import at, incidents, tuples


def payloads(spark, *items):
    texts = [(i if isinstance(i, str) else json.dumps(i),) for i in items]
    return spark.createDataFrame(texts, "value string").coalesce(1)


def weather(**current):
    base = {"dt": 1709251200, "weather": [{"main": "Rain"}, {"main": "Fog"}]}
    return {"current": {**base, "visibility": 9000, **current}}


@pytest.mark.parametrize(
    "current, expected",
    [
        ({"rain": {"1h": 0.3}}, (1709251200, "Rain", 9000, 0.3)),
        ({}, (1709251200, "Rain", 9000, 0.0)),
        ({"rain": None}, (1709251200, "Rain", 9000, 0.0)),
        ({"rain": {}}, (1709251200, "Rain", 9000, 0.0)),
        ({"rain": {"1h": None}}, (1709251200, "Rain", 9000, 0.0)),
        ({"weather": []}, (1709251200, None, 9000, 0.0)),
        ({"weather": None}, (1709251200, None, 9000, 0.0)),
        ({"visibility": None}, (1709251200, "Rain", None, 0.0)),
        ({"dt": None}, (None, "Rain", 9000, 0.0)),
    ],
)
def test_weather_payload(spark, current, expected):
    record = normalize.weather_records(payloads(spark, weather(**current))).first()
    assert tuple(record)[:4] == expected
    assert record["ingestion_time"].endswith("+00:00")


def test_junk_payloads_are_counted_and_dropped(spark):
    found = payloads(spark, "junk", "{}", weather())
    rows = normalize.weather_observations(normalize.weather_records(found))
    assert [r["weather_desc"] for r in rows.collect()] == ["Rain"]
    readable = normalize.readable(found, "weather")
    assert len(readable.collect()) == 1
    metrics = readable._jdf.queryExecution().observedMetrics()
    row = metrics.get("weather_payloads").get()
    assert (row.getLong(0), row.getLong(1)) == (3, 2)


def incident(code, magnitude=1, start="2024-03-01T00:00:40Z", id_="A"):
    return {
        "properties": {
            "id": id_,
            "iconCategory": code,
            "magnitudeOfDelay": magnitude,
            "startTime": start,
        }
    }


def test_incident_payload(spark):
    codes = (1, 2, 4, 5, 10, 11, 12, None)
    rows = normalize.incident_records(
        payloads(spark, {"incidents": [incident(c) for c in codes]}, "junk", {})
    )
    assert [r["type"] for r in rows.collect()] == [
        "Accident",
        "Category 12",
        "Category None",
    ]
    assert rows.columns == schemas.INCIDENT_RECORD.fieldNames()


def test_incident_start_times(spark):
    starts = ["2024-03-01T00:00:40Z", "bad", None, "2024-03-01T02:00:00+02"]
    payload = {"incidents": [incident(1, start=s) for s in starts]}
    rows = normalize.incidents(normalize.incident_records(payloads(spark, payload)))
    seconds = rows.select(F.unix_seconds("t_start")).collect()
    assert [r[0] for r in seconds] == [1709251240, None, None, 1709251200]
    since = normalize.started_since(rows, at(40))
    assert since.count() == 1
    assert normalize.started_since(rows, at(0)).count() == 2


def test_started_since_takes_a_column(spark):
    df = incidents(spark, [("A", 0), ("B", 10), ("C", None)])
    assert normalize.started_since(df, F.lit(at(10))).count() == 1


def test_records_survive_encoding(spark):
    rows = [(1709251200, "Rain", None, 0.25, "x"), (None, None, 1, None, None)]
    df = spark.createDataFrame(rows, schemas.WEATHER_RECORD)
    values = encode(df)
    assert values.columns == ["value"]
    assert '"visibility":null' in values.first()["value"]
    for column in (F.col("value"), F.col("value").cast("binary")):
        back = values.select(decode(column, schemas.WEATHER_RECORD).alias("r"))
        assert tuples(back.select("r.*")) == tuples(df)


def test_strict_json_types(spark):
    odd = {"timestamp": "1709251200", "weather": "Rain", "visibility": 10000.0}
    row = normalize.parse_weather(payloads(spark, odd)).first()
    assert row["w_timestamp"] is None
    assert row["visibility"] is None


def test_parse_topic_messages(spark):
    message = {"id": "A", "type": "t", "severity": "s", "start_time": "2024-03-01T00:00:40Z"}
    df = normalize.parse_incidents(payloads(spark, message, "junk"))
    assert df.columns == ["t_id", "t_type", "t_severity", "t_start"]
    kept = normalize.with_event_time(df, "t_start")
    assert [r["t_id"] for r in kept.collect()] == ["A"]


def test_bounding_box_includes_edges(spark):
    df = spark.createDataFrame(
        [(38.0, -90.0), (38.5, -90.5), (38.6, -90.0), (38.0, -90.6), (None, -90.0)],
        "lat double, lon double",
    )
    assert normalize.bounding_box(df, 38.0, -90.0, 0.5).count() == 2
