"""The context join: each incident with the observation nearest in time.

The answer depends on an incident's start time alone, so it is worked out once
per distinct start instant and then joined back:

1. observations shrink to one row per instant, incidents to their instants;
2. both are laid on one time line per bucket, and window functions carry the
   last observation before and the first after to every incident instant;
3. the incidents join the answer on their start time, and of those that found
   one the copies are dropped.

No pair of candidates is ever formed. Steps 1 and 2 handle distinct instants
only: at second precision a one-minute bucket holds at most 60 of each kind,
however many rows fall into it. Where times are finer than that, or buckets
long, ``slot_seconds`` cuts each bucket into slots that are worked apart, and
only each slot's first and last observation travel along the bucket. Step 3
meets one row per key on the answer's side, and adaptive execution splits a hot
start time (or broadcasts the answer if its measured size allows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contexture.functions.order import quoted
from contexture.operators.dedup import distinct_incidents, distinct_observations

TOLERANCE_SECONDS = 300
BUCKET_SECONDS = 60
CONTEXT_COLUMNS = ("weather_desc", "visibility", "rain")
JOINED_COLUMNS = ("t_id", "t_type", "t_severity", "t_start", *CONTEXT_COLUMNS)


def _time_line(
    incidents: DataFrame,
    observations: DataFrame,
    bucket_seconds: int | None,
    tolerance_seconds: int,
) -> DataFrame:
    """Instants of both sides by bucket; ``seen`` is null on incident rows.

    Times are microseconds, so that bucket starts are exact integers.
    """
    width = (bucket_seconds or tolerance_seconds) * 1_000_000
    bucket = f"at - pmod(at, {width})"
    reached = bucket
    if bucket_seconds is None:
        # An observation within tolerance lies in the incident's own bucket or
        # in a neighbour, so it is placed in three.
        reached = f"explode(array({bucket} - {width}, {bucket}, {bucket} + {width}))"
    columns = ", ".join(quoted(c) for c in observations.columns)
    seen = (
        distinct_observations(observations)
        .selectExpr("unix_micros(w_timestamp) AS at", "*")
        .selectExpr(f"{reached} AS bucket", "at", f"struct(at, {columns}) AS seen")
    )
    starts = (
        incidents.where("t_start IS NOT NULL")
        .select("t_start")
        .distinct()
        .selectExpr("unix_micros(t_start) AS at")
        .selectExpr(f"{bucket} AS bucket", "at")
    )
    return seen.unionByName(starts, allowMissingColumns=True)


_LAST_SEEN = "last_value({0}) IGNORE NULLS OVER (PARTITION BY {1} ORDER BY {2} {3})"
_EARLIER_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _neighbours(line: DataFrame, keys: str) -> DataFrame:
    """Incident rows with the last observation before and the first after.

    Each group of ``keys`` is looked at by itself. The default frame takes in
    rows of equal time, so an observation at the very instant of an incident is
    met both ways.
    """
    return line.selectExpr(
        "*",
        _LAST_SEEN.format("seen", keys, "at", "ASC") + " AS before",
        _LAST_SEEN.format("seen", keys, "at", "DESC") + " AS after",
    ).where("seen IS NULL")


def _neighbours_by_slot(line: DataFrame, slot_seconds: int) -> DataFrame:
    """The same over whole buckets, with windows no longer than a slot.

    Where a slot has no observation on one side of an incident, the nearest
    other slot's first or last one stands in. ``seen`` begins with its time, so
    its least and greatest are first and last.
    """
    line = line.selectExpr("*", f"at - pmod(at, {slot_seconds * 1_000_000}) AS slot")
    ends = line.groupBy("bucket", "slot").agg(
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")
    )
    earlier = _LAST_SEEN.format("last_seen", "bucket", "slot", f"ASC {_EARLIER_ROWS}")
    later = _LAST_SEEN.format("first_seen", "bucket", "slot", f"DESC {_EARLIER_ROWS}")
    ends = ends.selectExpr("bucket", "slot", f"{earlier} AS earlier", f"{later} AS later")
    return (
        _neighbours(line, "bucket, slot")
        .join(ends, ["bucket", "slot"])
        .selectExpr(
            "at", "coalesce(before, earlier) AS before", "coalesce(after, later) AS after"
        )
    )


def nearest_observation(
    incidents: DataFrame,
    observations: DataFrame,
    bucket_seconds: int | None = BUCKET_SECONDS,
    tolerance_seconds: int = TOLERANCE_SECONDS,
    slot_seconds: int | None = None,
) -> DataFrame:
    """Per distinct ``t_start``, all columns of the nearest observation.

    Ties go to the earlier observation, then to the least by its other columns,
    nulls last. Instants without an observation in reach are left out. With
    ``bucket_seconds=None`` only the tolerance bounds the reach; otherwise both
    must also share a bucket. ``slot_seconds`` changes no result.
    """
    line = _time_line(incidents, observations, bucket_seconds, tolerance_seconds)
    if slot_seconds:
        found = _neighbours_by_slot(line, slot_seconds)
    else:
        found = _neighbours(line, "bucket")
    nearest = """CASE WHEN after IS NULL OR at - before.at <= after.at - at
                      THEN before ELSE after END"""
    return (
        found.selectExpr("at", f"{nearest} AS nearest")
        .where(f"abs(nearest.at - at) <= {tolerance_seconds * 1_000_000}")
        .selectExpr(
            "timestamp_micros(at) AS t_start",
            *[f"nearest.{quoted(c)}" for c in observations.columns],
        )
    )


def context_join(
    incidents: DataFrame,
    observations: DataFrame,
    bucket_seconds: int | None = BUCKET_SECONDS,
    tolerance_seconds: int = TOLERANCE_SECONDS,
    context: Sequence[str] = CONTEXT_COLUMNS,
    required: str | None = "weather_desc",
    slot_seconds: int | None = None,
) -> DataFrame:
    """Distinct incidents with the nearest observation's ``context`` columns.

    Incidents without one, and those whose ``required`` column is null, drop
    out.
    """
    answer = nearest_observation(
        incidents,
        observations.select("w_timestamp", *context),
        bucket_seconds,
        tolerance_seconds,
        slot_seconds,
    )
    if required:
        answer = answer.where(f"{quoted(required)} IS NOT NULL")
    rows = incidents.where("t_start IS NOT NULL").join(
        answer.select("t_start", *context), "t_start"
    )
    # The answer depends on the start time alone, so copies can go after the
    # join, where few rows are left; plain copies first, which needs no order.
    # The time is taken through its number, so that the join's shuffle does not
    # serve for what follows: else a hot start time could not be split.
    rows = rows.withColumn("t_start", F.expr("timestamp_micros(unix_micros(t_start))"))
    return distinct_incidents(rows.distinct()).select(*incidents.columns, *context)
