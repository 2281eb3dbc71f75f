"""Raw payloads to records, and records to typed rows.

Nothing here shuffles. All functions take batch and streaming input alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contexture import schemas
from contexture.functions.codes import (
    category_label,
    is_context_category,
    severity_label,
)
from contexture.functions.records import decode
from contexture.functions.times import (
    OFFSET_PATTERN,
    epoch_to_timestamp,
    parse_time,
    utc_stamp,
)


def readable(payloads: DataFrame, feed: str, column: str = "value") -> DataFrame:
    """Payloads that can be read; all and the rejected ones are counted.

    ``feed`` is ``weather`` or ``incidents``; the counts are observed metrics
    ``rows`` and ``rejects`` under ``<feed>_payloads``.
    """
    schema, field = {
        "weather": (schemas.WEATHER_PAYLOAD, "current"),
        "incidents": (schemas.INCIDENT_PAYLOAD, "incidents"),
    }[feed]
    bad = decode(F.col(column), schema)[field].isNull()
    counted = payloads.observe(
        f"{feed}_payloads", F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("rejects")
    )
    return counted.where(~bad)


def weather_records(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Raw weather payloads to flat records, one each; unreadable ones give none.

    Missing rain, a missing rain figure and a null one all read 0.0; an empty
    list of conditions gives a null label.
    """
    payload = decode(F.col(column), schemas.WEATHER_PAYLOAD)
    current = payloads.select(payload["current"].alias("c")).where("c IS NOT NULL")
    return current.select(
        F.col("c.dt").alias("timestamp"),
        F.get("c.weather", F.lit(0))["main"].alias("weather"),
        F.col("c.visibility").alias("visibility"),
        F.coalesce(F.col("c.rain.`1h`"), F.lit(0.0)).alias("rain"),
        utc_stamp().alias("ingestion_time"),
    )


def incident_records(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Raw incident payloads to flat records, one per incident.

    Categories that describe the weather are left out; a missing category is
    kept.
    """
    payload = decode(F.col(column), schemas.INCIDENT_PAYLOAD)
    rows = payloads.select(F.explode(payload["incidents"]).alias("i"))
    rows = rows.select("i.properties.*").filter(
        ~is_context_category(F.col("iconCategory"))
    )
    return rows.select(
        "id",
        category_label(F.col("iconCategory")).alias("type"),
        severity_label(F.col("magnitudeOfDelay")).alias("severity"),
        F.col("startTime").alias("start_time"),
        utc_stamp().alias("ingestion_time"),
    )


def parse_weather(messages: DataFrame, column: str = "value") -> DataFrame:
    """Topic messages to observations."""
    record = decode(F.col(column), schemas.WEATHER_RECORD)
    return weather_observations(messages.select(record.alias("r")).select("r.*"))


def parse_incidents(
    messages: DataFrame,
    column: str = "value",
    patterns: Sequence[str] = (OFFSET_PATTERN,),
) -> DataFrame:
    """Topic messages to incidents."""
    record = decode(F.col(column), schemas.INCIDENT_RECORD)
    return incidents(messages.select(record.alias("r")).select("r.*"), patterns)


def weather_observations(records: DataFrame) -> DataFrame:
    """Weather records to observations on event time."""
    return records.select(
        epoch_to_timestamp(F.col("timestamp")).alias("w_timestamp"),
        F.col("weather").alias("weather_desc"),
        "visibility",
        "rain",
    )


def incidents(
    records: DataFrame, patterns: Sequence[str] = (OFFSET_PATTERN,)
) -> DataFrame:
    """Incident records to incidents on event time; an unreadable start is null."""
    return records.select(
        F.col("id").alias("t_id"),
        F.col("type").alias("t_type"),
        F.col("severity").alias("t_severity"),
        parse_time(F.col("start_time"), patterns).alias("t_start"),
    )


def started_since(df: DataFrame, since: datetime | Column, time: str = "t_start"):
    """Rows at or after ``since``; rows without a time go too.

    ``since`` is the caller's, so a restart need not move it.
    """
    return df.filter(F.col(time) >= (since if isinstance(since, Column) else F.lit(since)))


def with_event_time(df: DataFrame, time: str, metric: str | None = None) -> DataFrame:
    """Drop rows without an event time, counting them.

    The counts appear as observed metrics under the name ``metric`` in a
    streaming query's progress, or in a batch query's listener events.
    """
    if metric:
        missing = F.count_if(F.col(time).isNull())
        df = df.observe(
            metric, F.count(F.lit(1)).alias("rows"), missing.alias("without_time")
        )
    return df.filter(F.col(time).isNotNull())


def bounding_box(
    df: DataFrame,
    latitude: float,
    longitude: float,
    offset: float = 0.5,
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Rows within ``offset`` degrees of a point, edges included."""
    return df.filter(
        F.col(lat).between(latitude - offset, latitude + offset)
        & F.col(lon).between(longitude - offset, longitude + offset)
    )
