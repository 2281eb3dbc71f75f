"""Rates, counts and breakdowns over the joined and the observation table.

Every distinct count groups by (label, id) first and by label after, which is
how Spark plans a single distinct aggregate. A label holding a third of all
rows therefore spreads over its ids, and its copies merge on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contexture.functions.bands import VISIBILITY_BANDS, Bands
from contexture.functions.codes import SEVERITIES

OTHER = "Other"


def _rate(numerator: str, denominator: str) -> Column:
    """Missing counts are 0; a denominator of 0 gives null."""
    return F.expr(f"coalesce({numerator}, 0) / nullif({denominator}, 0)")


def rate_by_context(
    observations: DataFrame,
    joined: DataFrame,
    label: str = "weather_desc",
    incident_id: str = "t_id",
    time: str = "w_timestamp",
) -> DataFrame:
    """Distinct incidents per distinct observed instant, for each label observed.

    Both sides are counted before they meet, so the join is one row per label
    on either side. A label without incidents has rate 0, and so has the null
    label.
    """
    observed = observations.groupBy(label).agg(F.countDistinct(time).alias("_observed"))
    counted = joined.groupBy(label).agg(F.countDistinct(incident_id).alias("_incidents"))
    return rates(observed, counted, label)


def rates(observed: DataFrame, counted: DataFrame, label: str) -> DataFrame:
    """``incident_rate`` from ``_observed`` and ``_incidents`` by label."""
    return observed.join(counted, label, "left").select(
        label, _rate("_incidents", "_observed").alias("incident_rate")
    )


def severity_by_context(
    joined: DataFrame,
    label: str = "weather_desc",
    severity: str = "t_severity",
    incident_id: str = "t_id",
    ordered: bool = True,
) -> DataFrame:
    """Distinct incidents by (label, severity), nulls in either left out."""
    counts = (
        joined.filter(F.col(severity).isNotNull() & F.col(label).isNotNull())
        .groupBy(label, severity)
        .agg(F.countDistinct(incident_id).alias("incident_count"))
    )
    return counts.orderBy(label, severity) if ordered else counts


def severity_pivot(
    joined: DataFrame,
    label: str = "weather_desc",
    severity: str = "t_severity",
    incident_id: str = "t_id",
    severities: Sequence[str] = SEVERITIES,
    other: str | None = OTHER,
) -> DataFrame:
    """One row per label, one column per severity, 0 where there is none.

    The severities are given, so no pass over the data is spent finding them.
    Those not among them are added up under ``other``: a row's columns always
    sum to what ``severity_by_context`` has for its label. Where all are given, as
    a table's manifest lists them, ``other=None`` leaves that column out.
    """
    counts = severity_by_context(joined, label, severity, incident_id, ordered=False)
    return pivoted(counts, label, severity, severities, other)


def pivoted(
    counts: DataFrame,
    label: str = "weather_desc",
    severity: str = "t_severity",
    severities: Sequence[str] = SEVERITIES,
    other: str | None = OTHER,
) -> DataFrame:
    """``severity_pivot`` from ``incident_count`` by (label, severity)."""
    columns = list(dict.fromkeys([*severities, *([other] if other else [])]))
    if other:
        listed = F.when(F.col(severity).isin(columns), F.col(severity)).otherwise(other)
        counts = counts.withColumn(severity, listed)
    wide = counts.groupBy(label).pivot(severity, columns)
    return wide.agg(F.sum("incident_count")).na.fill(0, columns)


def count_by_context(
    joined: DataFrame,
    label: str = "weather_desc",
    keep_null: bool = False,
    name: str = "incident_count",
) -> DataFrame:
    """Rows by label; the null label is left out unless asked for."""
    rows = joined if keep_null else joined.filter(F.col(label).isNotNull())
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias(name))


def _by_band(
    df: DataFrame, value: str, counted: str, name: str, bands: Bands
) -> DataFrame:
    """Distinct ``counted`` by band; grouping is on the small integer rank."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(bands.rank(value).alias("bucket_rank"))
        .agg(F.countDistinct(counted).alias(name))
    )


def _labelled(df: DataFrame, bands: Bands, *columns: Column | str) -> DataFrame:
    label = bands.label_of_rank("bucket_rank").alias("vis_range")
    return df.select(label, "bucket_rank", *columns)


def minutes_by_bucket(
    observations: DataFrame,
    value: str = "visibility",
    time: str = "w_timestamp",
    bands: Bands = VISIBILITY_BANDS,
) -> DataFrame:
    """Distinct observed instants by band of ``value``.

    The unit is an observation instant; it is a minute when one observation is
    taken per minute.
    """
    counts = _by_band(observations, value, time, "minute_count", bands)
    return _labelled(counts, bands, "minute_count")


def incidents_by_bucket(
    joined: DataFrame,
    value: str = "visibility",
    incident_id: str = "t_id",
    bands: Bands = VISIBILITY_BANDS,
) -> DataFrame:
    """Distinct incidents by band of ``value``."""
    counts = _by_band(joined, value, incident_id, "incident_count", bands)
    return _labelled(counts, bands, "incident_count")


def rate_by_bucket(
    observations: DataFrame,
    joined: DataFrame,
    value: str = "visibility",
    incident_id: str = "t_id",
    time: str = "w_timestamp",
    bands: Bands = VISIBILITY_BANDS,
    ordered: bool = True,
) -> DataFrame:
    """Distinct incidents per distinct observed instant, for each observed band."""
    observed = _by_band(observations, value, time, "minute_count", bands)
    counted = _by_band(joined, value, incident_id, "incident_count", bands)
    found = band_rates(observed, counted, bands)
    return found.orderBy("bucket_rank") if ordered else found


def band_rates(
    observed: DataFrame, counted: DataFrame, bands: Bands = VISIBILITY_BANDS
) -> DataFrame:
    """``incident_rate`` from ``minute_count`` and ``incident_count`` by ``bucket_rank``."""
    rate = _rate("incident_count", "minute_count")
    both = observed.join(counted, "bucket_rank", "left")
    return _labelled(both, bands, rate.alias("incident_rate"))
