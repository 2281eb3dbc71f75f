"""Event-time expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: start times carry "Z" or a two-digit offset.
OFFSET_PATTERN = "yyyy-MM-dd'T'HH:mm:ssX"

# Optional further forms: "+02:00" offsets and fractions of a second.
WIDE_PATTERNS = (
    OFFSET_PATTERN,
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSS][S]X",
    "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSS][S]XXX",
)


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def parse_time(text: Column, patterns: Sequence[str] = (OFFSET_PATTERN,)) -> Column:
    """First pattern that fits; null, not an error, where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])


def bucket_number(time: Column, seconds: int = 60) -> Column:
    """Number of the tumbling bucket; floors, so times before 1970 fit too."""
    return F.floor(F.unix_seconds(time) / F.lit(seconds)).cast("long")


def within(time: Column, centre: Column, seconds: int) -> Column:
    """``time`` lies in ``centre`` +/- ``seconds``, both ends included."""
    span = F.make_dt_interval(secs=F.lit(seconds))
    return time.between(centre - span, centre + span)


def utc_stamp() -> Column:
    """Processing time as an ISO-8601 string with offset."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
