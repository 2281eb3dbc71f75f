"""One row per key, chosen by a total order so that reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame

from contexture.functions.order import least_row

INCIDENT_KEY = ["t_id", "t_start"]
OBSERVATION_KEY = ["w_timestamp"]


def _distinct(df: DataFrame, key: list[str], time: str) -> DataFrame:
    rows = df.where(f"{time} IS NOT NULL")
    rest = [c for c in df.columns if c not in key]
    return least_row(rows, key, rest) if rest else rows.distinct()


def distinct_incidents(incidents: DataFrame) -> DataFrame:
    """One row per ``(t_id, t_start)``: repeated polls deliver it again.

    Rows without a start time have no place on the time line and are left out.
    """
    return _distinct(incidents, INCIDENT_KEY, "t_start")


def distinct_observations(observations: DataFrame) -> DataFrame:
    """One row per instant, least by the remaining columns, nulls last.

    Rows without an instant are left out.
    """
    return _distinct(observations, OBSERVATION_KEY, "w_timestamp")
