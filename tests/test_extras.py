from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from contexture import schemas
from contexture.operators import extras, normalize


def found(spark, *values, schema=schemas.WEATHER_PAYLOAD):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    rows = extras.extras(df, schema).select("path", F.to_json("found").alias("j")).collect()
    return sorted(((r.path, None if r.j is None else json.loads(r.j)) for r in rows), key=str)


def weather(**more):
    current = {"dt": 1, "weather": [{"main": "Rain"}], "visibility": 3, "rain": {"1h": 1.0}}
    return json.dumps({"current": current | more})


def test_named_fields_are_no_extras(spark):
    assert found(spark, weather(), "{}", '{"current":null}') == []


def test_fields_come_out_whole_where_they_stand(spark):
    payload = {
        "current": {"wind": {"speed": 1, "deep": [{"x": 2}]}, "weather": [{"id": 3}, {"id": 4}]},
        "lat": 1.5,
    }
    assert found(spark, json.dumps(payload)) == [
        ("$.current.weather[*].id", 3),
        ("$.current.weather[*].id", 4),
        ("$.current.wind", {"speed": 1, "deep": [{"x": 2}]}),
        ("$.lat", 1.5),
    ]


def test_a_null_field_is_a_field(spark):
    assert found(spark, weather(uvi=None)) == [("$.current.uvi", None)]


def test_names_with_signs_are_not_taken_for_paths(spark):
    text = json.dumps({"current.dt": 1, "a'b": 2, "x[*]": 3, "$": 4, "": 5})
    assert dict(found(spark, text)) == {
        "$.$": 4,
        "$['']": 5,
        "$['a\\'b']": 2,
        "$['current.dt']": 1,
        "$['x[*]']": 3,
    }


def test_values_of_another_kind_stay_under_their_own_path(spark):
    assert found(spark, '{"current":"text"}') == [("$.current", "text")]
    assert found(spark, '{"current":{"weather":{"main":1}}}') == [("$.current.weather", {"main": 1})]
    assert found(spark, "[]", "7") == [("$", 7), ("$", [])]


@pytest.mark.parametrize("value", ["junk", None, "", '{"a":1', '{"a":1,"a":2}'])
def test_unreadable_payloads_are_one_row_each(spark, value):
    assert found(spark, value) == [("$", None)]


def test_long_payload_and_empty_table(spark):
    items = [{"properties": {"id": str(n), "n": n}, "g": "x" * 50} for n in range(20_000)]
    df = spark.createDataFrame([(json.dumps({"incidents": items}),)], "value string")
    counted = extras.counts(extras.extras(df, schemas.INCIDENT_PAYLOAD)).collect()
    assert {tuple(r) for r in counted} == {
        ("$.incidents[*].g", "STRING", 20_000),
        ("$.incidents[*].properties.n", "NUMBER", 20_000),
    }
    assert extras.extras(df.limit(0), schemas.INCIDENT_PAYLOAD).collect() == []


def test_extras_can_be_stored_and_asked(spark, folder):
    df = spark.createDataFrame([(weather(wind={"speed": 2.5}),)], "value string")
    path = folder("extras")
    extras.extras(df, schemas.WEATHER_PAYLOAD).write.parquet(path)
    speed = F.variant_get("found", "$.speed", "double")
    assert spark.read.parquet(path).select(speed).collect() == [(2.5,)]


def test_extras_leave_the_records_alone(spark):
    df = spark.createDataFrame([(weather(wind={"speed": 1}, dew=1),), (weather(),)], "value string")
    rows = normalize.weather_records(df).drop("ingestion_time").collect()
    assert rows == [(1, "Rain", 3, 1.0)] * 2


def test_streams_too(spark, folder):
    path = folder("landed")
    spark.createDataFrame([(weather(wind=1),), ("junk",)], "value string").write.text(path)
    rows = extras.extras(spark.readStream.text(path), schemas.WEATHER_PAYLOAD)
    out = folder("out")
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", folder("ckpt"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["$", "$.current.wind"]
