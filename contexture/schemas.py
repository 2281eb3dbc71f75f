"""Declared schemas of payloads, records and tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_STRING, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DOUBLE, _TIME = T.DoubleType(), T.TimestampType()

# Raw payloads, as the two feeds deliver them.
WEATHER_PAYLOAD = _struct(
    current=_struct(
        dt=_LONG,
        weather=T.ArrayType(_struct(main=_STRING)),
        visibility=_INT,
        rain=_struct(**{"1h": _DOUBLE}),
    )
)
INCIDENT_PAYLOAD = _struct(
    incidents=T.ArrayType(
        _struct(
            properties=_struct(
                id=_STRING,
                iconCategory=_INT,
                magnitudeOfDelay=_INT,
                startTime=_STRING,
            )
        )
    )
)

# Records on the topics.
WEATHER_RECORD = _struct(
    timestamp=_LONG,
    weather=_STRING,
    visibility=_INT,
    rain=_DOUBLE,
    ingestion_time=_STRING,
)
INCIDENT_RECORD = _struct(
    id=_STRING,
    type=_STRING,
    severity=_STRING,
    start_time=_STRING,
    ingestion_time=_STRING,
)

# Tables.
JOINED_TABLE = _struct(
    t_id=_STRING,
    t_type=_STRING,
    t_severity=_STRING,
    t_start=_TIME,
    weather_desc=_STRING,
    visibility=_INT,
    rain=_DOUBLE,
)
OBSERVATION_TABLE = _struct(w_timestamp=_TIME, weather_desc=_STRING, visibility=_INT)

# Live snapshot: each part carries when it was written and when it lapses.
_STAMPS = {"updated_at": _TIME, "expires_at": _TIME}
SNAPSHOT_RECENT = T.StructType(JOINED_TABLE.fields + _struct(**_STAMPS).fields)
SNAPSHOT_COUNTS = _struct(weather_desc=_STRING, count=_LONG, **_STAMPS)
SNAPSHOT_UPDATE = _struct(last_update_ts=_STRING, **_STAMPS)
