"""The ``events`` table in both roles, observation and incident.

Every fourth event is delivered twice, as a repeated poll would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contexture.functions.codes import (
    category_label,
    is_context_category,
    severity_label,
)
from contexture.operators.context import context_join
from contexture.operators.dedup import distinct_observations
from contexture.session import pin_utc

OBSERVED = "event_type IN ('view', 'click')"
INCIDENT = "event_type IN ('error', 'purchase', 'signup')"

# The stored time has no zone; watermarks and epoch casts need one.
EXACT = "CAST(ts AS TIMESTAMP)"
SECOND = f"date_trunc('second', {EXACT})"
TWICE = "event_id % 4 = 0"
POLL = f"explode(IF({TWICE}, array(1, 2), array(1))) AS poll"

K = "CAST(get_json_object(props, '$.k') AS INT)"
CONDITION = f"get(array('Clear', 'Clouds', 'Rain', 'Snow', 'Mist'), {K} % 6)"
VISIBILITY = "IF(event_id % 13 = 0, NULL, CAST(floor(value * 200) AS INT))"
RAIN = "IF(event_id % 3 = 0, value, 0.0D)"

INCIDENT_ID = "concat('TTI-', user_id)"
CATEGORY = "IF(event_id % 17 = 0, NULL, CAST(event_id % 15 AS INT))"
MAGNITUDE = "IF(event_id % 19 = 0, NULL, CAST(user_id % 6 AS INT))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/events.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a file stream."""
    schema = events(spark, sf_dir).schema
    # A pattern that fits this name alone: a stream takes a single file only
    # by pattern, and a folder of files either way.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def observations(source: DataFrame, time: str = SECOND) -> DataFrame:
    """Observations as they arrive, repeated polls included."""
    return (
        source.where(OBSERVED)
        .selectExpr(
            f"{time} AS w_timestamp",
            f"{CONDITION} AS weather_desc",
            f"{VISIBILITY} AS visibility",
            f"{RAIN} AS rain",
            POLL,
        )
        .drop("poll")
    )


def incidents(source: DataFrame, time: str = SECOND) -> DataFrame:
    """Incidents as they arrive, weather categories left out."""
    code = F.expr(CATEGORY)
    return (
        source.where(INCIDENT)
        .where(~is_context_category(code))
        .select(
            F.expr(INCIDENT_ID).alias("t_id"),
            category_label(code).alias("t_type"),
            severity_label(F.expr(MAGNITUDE)).alias("t_severity"),
            F.expr(time).alias("t_start"),
            F.expr(POLL),
        )
        .drop("poll")
    )


def joined_table(source: DataFrame) -> DataFrame:
    return context_join(incidents(source), observations(source))


def observation_table(source: DataFrame) -> DataFrame:
    # Chosen with rain in view, as in the join, so both share one shuffle.
    return distinct_observations(observations(source)).drop("rain")


def weather_payloads(source: DataFrame) -> DataFrame:
    """One raw payload per poll; some are junk, some lack rain or conditions."""
    conditions = f"""IF(event_id % 11 = 0,
        CAST(array() AS ARRAY<STRUCT<main: STRING>>), array(struct({CONDITION} AS main)))"""
    current = f"""struct(unix_seconds({SECOND}) AS dt, {conditions} AS weather,
        {VISIBILITY} AS visibility,
        IF(event_id % 3 = 0, struct(value AS `1h`), NULL) AS rain)"""
    payload = f"IF(event_id % 29 = 0, 'junk', to_json(struct({current} AS current)))"
    return source.where(OBSERVED).selectExpr(f"{payload} AS value", POLL).drop("poll")


def incident_payloads(source: DataFrame) -> DataFrame:
    """One raw payload per event; a repeated incident stands in its list twice."""
    local = f"""date_format({SECOND}, "yyyy-MM-dd'T'HH:mm:ss")"""
    start = f"""CASE event_id % 23 WHEN 0 THEN 'bad'
        WHEN 1 THEN concat({local}, '+02') ELSE concat({local}, 'Z') END"""
    item = f"""struct(struct({INCIDENT_ID} AS id, {CATEGORY} AS iconCategory,
        {MAGNITUDE} AS magnitudeOfDelay, {start} AS startTime) AS properties)"""
    items = f"array_repeat({item}, IF({TWICE}, 2, 1))"
    payload = f"IF(event_id % 29 = 0, 'junk', to_json(struct({items} AS incidents)))"
    return source.where(INCIDENT).selectExpr(f"{payload} AS value")


def later_weather_payloads(source: DataFrame) -> DataFrame:
    """Weather payloads with fields that no schema here names, some of them now and then."""
    conditions = f"""IF(event_id % 11 = 0, CAST(array() AS ARRAY<STRUCT<main: STRING, id: INT>>),
        array(struct({CONDITION} AS main, {K} AS id)))"""
    current = f"""struct(unix_seconds({SECOND}) AS dt, {conditions} AS weather,
        {VISIBILITY} AS visibility, struct(value AS speed, {K} AS deg) AS wind,
        IF(event_id % 3 = 0, struct(value AS `1h`, value AS `3h`), NULL) AS rain)"""
    all_ = f"""struct({current} AS current, IF(event_id % 5 = 0, value, NULL) AS lat,
        IF(event_id % 7 = 0, array(event_type), NULL) AS `alerts.v2`)"""
    payload = f"IF(event_id % 29 = 0, 'junk', to_json({all_}))"
    return source.where(OBSERVED).selectExpr(f"{payload} AS value", POLL).drop("poll")


def later_incident_payloads(source: DataFrame) -> DataFrame:
    """Incident payloads with a shape, and at times a length and a flag, for each incident."""
    item = f"""struct(struct({INCIDENT_ID} AS id, {CATEGORY} AS iconCategory,
            {MAGNITUDE} AS magnitudeOfDelay, IF(event_id % 2 = 0, value, NULL) AS length,
            IF(event_id % 10 = 1, true, NULL) AS probable) AS properties,
        struct('Point' AS type, array(value, value) AS coordinates) AS geometry)"""
    items = f"array_repeat({item}, IF({TWICE}, 2, 1))"
    payload = f"IF(event_id % 29 = 0, 'junk', to_json(struct({items} AS incidents)))"
    return source.where(INCIDENT).selectExpr(f"{payload} AS value")
