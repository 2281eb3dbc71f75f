from __future__ import annotations

from datetime import datetime, timedelta, timezone

from contexture import schemas

START = datetime(2024, 3, 1, tzinfo=timezone.utc)

INCIDENTS = "t_id string, t_type string, t_severity string, t_start timestamp"
OBSERVATIONS = "w_timestamp timestamp, weather_desc string, visibility int, rain double"


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def incidents(spark, rows):
    """Rows are (id, seconds) or (id, seconds, type, severity)."""
    full = [
        (r[0], *(r[2:] or ("Accident", "Minor")), None if r[1] is None else at(r[1]))
        for r in rows
    ]
    return spark.createDataFrame(full, INCIDENTS)


def observations(spark, rows):
    """Rows are (seconds, label) or (seconds, label, visibility, rain)."""
    full = [
        (None if r[0] is None else at(r[0]), r[1], *(r[2:] or (10000, 0.0)))
        for r in rows
    ]
    return spark.createDataFrame(full, OBSERVATIONS)


def joined(spark, rows):
    """Rows are (id, seconds, severity, label, visibility)."""
    full = [
        (r[0], "Accident", r[2], at(r[1]), r[3], r[4], 0.0) for r in rows
    ]
    return spark.createDataFrame(full, schemas.JOINED_TABLE)


def observed(spark, rows):
    """Rows are (seconds, label, visibility)."""
    full = [(None if r[0] is None else at(r[0]), r[1], r[2]) for r in rows]
    return spark.createDataFrame(full, schemas.OBSERVATION_TABLE)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))
