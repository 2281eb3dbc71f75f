"""Event-time streams with watermarks, and stateful de-duplication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame

from contexture.functions.times import OFFSET_PATTERN
from contexture.operators.dedup import INCIDENT_KEY, OBSERVATION_KEY
from contexture.operators.normalize import (
    parse_incidents,
    parse_weather,
    started_since,
    with_event_time,
)

WATERMARK_DELAY = "10 minutes"


def combine_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the first row per key within each Arrow batch.

    Stateful de-duplication shuffles every row to its key's partition, with no
    combining on the map side. Where one key makes up a large part of a
    micro-batch, this lets one row per batch of rows through in its place. It
    takes every row through Python, so it is off unless asked for.
    """
    names = list(keys)

    def first_rows(batches: Iterator) -> Iterator:
        # Imported on the executor.
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = pa.table(
                [*(batch.column(n) for n in names), pa.array(np.arange(batch.num_rows))],
                names=[*names, "_row"],
            )
            first = rows.group_by(names).aggregate([("_row", "min")])["_row_min"]
            yield batch.take(first.combine_chunks())

    return df.mapInArrow(first_rows, df.schema)


def observation_stream(
    observations: DataFrame,
    delay: str = WATERMARK_DELAY,
    metric: str | None = "observations_in",
    combine: bool = False,
) -> DataFrame:
    """Watermarked observations; rows without a time are counted and dropped.

    ``combine`` may drop observations that share an instant, so it is for uses
    that keep any one of them.
    """
    rows = with_event_time(observations, "w_timestamp", metric)
    if combine:
        rows = combine_copies(rows, OBSERVATION_KEY)
    return rows.withWatermark("w_timestamp", delay)


def incident_stream(
    incidents: DataFrame,
    since: datetime | Column | None = None,
    delay: str = WATERMARK_DELAY,
    metric: str | None = "incidents_in",
    combine: bool = False,
) -> DataFrame:
    """Watermarked incidents; rows without a time are counted and dropped.

    ``combine`` may drop rows that share ``(t_id, t_start)``, so it is for uses
    that keep any one of them.
    """
    rows = with_event_time(incidents, "t_start", metric)
    if since is not None:
        rows = started_since(rows, since)
    if combine:
        rows = combine_copies(rows, INCIDENT_KEY)
    return rows.withWatermark("t_start", delay)


def weather_from_topic(
    messages: DataFrame, delay: str = WATERMARK_DELAY, combine: bool = False
) -> DataFrame:
    return observation_stream(parse_weather(messages), delay, combine=combine)


def incidents_from_topic(
    messages: DataFrame,
    since: datetime | Column | None = None,
    delay: str = WATERMARK_DELAY,
    combine: bool = False,
    patterns: Sequence[str] = (OFFSET_PATTERN,),
) -> DataFrame:
    rows = parse_incidents(messages, patterns=patterns)
    return incident_stream(rows, since, delay, combine=combine)


def distinct_incident_stream(incidents: DataFrame) -> DataFrame:
    """The first row to arrive for each ``(t_id, t_start)``.

    The start time is part of the key, so the watermark lets old keys go.
    """
    return incidents.dropDuplicates(INCIDENT_KEY)


def distinct_observation_stream(observations: DataFrame) -> DataFrame:
    """The observation table's rows: the first to arrive for each instant."""
    rows = observations.select("w_timestamp", "weather_desc", "visibility")
    return rows.dropDuplicates(OBSERVATION_KEY)
