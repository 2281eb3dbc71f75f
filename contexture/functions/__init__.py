"""Column expressions. All are built from Spark's own functions."""

from contexture.functions.bands import VISIBILITY_BANDS, Bands
from contexture.functions.codes import (
    category_label,
    is_context_category,
    severity_label,
)
from contexture.functions.records import decode, encode
from contexture.functions.times import (
    OFFSET_PATTERN,
    bucket_number,
    epoch_to_timestamp,
    parse_time,
    utc_stamp,
    within,
)

__all__ = [
    "VISIBILITY_BANDS",
    "Bands",
    "category_label",
    "is_context_category",
    "severity_label",
    "decode",
    "encode",
    "OFFSET_PATTERN",
    "bucket_number",
    "epoch_to_timestamp",
    "parse_time",
    "utc_stamp",
    "within",
]
