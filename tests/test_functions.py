from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contexture.functions import (
    VISIBILITY_BANDS,
    Bands,
    bucket_number,
    category_label,
    is_context_category,
    parse_time,
    severity_label,
    within,
)
from contexture.functions.codes import SEVERITIES, lookup
from contexture.functions.order import least_row
from contexture.functions.times import WIDE_PATTERNS, utc_stamp
from tests.helpers import at


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_category_labels(spark):
    df = spark.createDataFrame([(1,), (12,), (14,), (None,)], "c int").coalesce(1)
    assert values(df, category_label(F.col("c"))) == [
        "Accident",
        "Category 12",
        "Broken Down Vehicle",
        "Category None",
    ]


def test_severity_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (5,), (None,)], "c int")
    assert values(df.coalesce(1), severity_label(F.col("c"))) == [
        "Undefined",
        "Minor",
        "Moderate",
        "Major",
        "Undefined",
        "Unknown",
        "Unknown",
    ]
    assert SEVERITIES == ("Major", "Minor", "Moderate", "Undefined", "Unknown")


def test_context_categories_keep_null_defined(spark):
    df = spark.createDataFrame([(c,) for c in (2, 4, 5, 10, 11, 1, None)], "c int")
    assert values(df.coalesce(1), is_context_category(F.col("c"))) == [
        True,
        True,
        True,
        True,
        True,
        False,
        False,
    ]


def test_lookup_quotes_labels(spark):
    df = spark.createDataFrame([(1,)], "c int")
    label = lookup(F.col("c"), {1: "driver's \\ side"}, F.lit("none"))
    assert values(df, label) == ["driver's \\ side"]


def test_parse_time(spark):
    texts = [
        "2024-03-01T00:00:40Z",
        "2024-03-01T02:00:40+02",
        "2024-03-01T02:00:40+02:00",
        "2024-03-01T00:00:40.5Z",
        "bad",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    seconds = F.unix_micros(parse_time(F.col("s")))
    at_40 = 1709251240_000_000
    assert values(df, seconds) == [at_40, at_40, None, None, None, None]
    wide = F.unix_micros(parse_time(F.col("s"), WIDE_PATTERNS))
    assert values(df, wide) == [at_40, at_40, at_40, at_40 + 500_000, None, None]


def test_bucket_number_floors(spark):
    df = spark.sql("SELECT explode(array(-61, -60, -1, 0, 59, 60)) AS s").coalesce(1)
    minutes = bucket_number(F.timestamp_seconds("s"))
    assert values(df, minutes) == [-2, -1, -1, 0, 0, 1]
    assert values(df, bucket_number(F.timestamp_seconds("s"), 30)) == [-3, -2, -1, 0, 1, 2]


def test_within_includes_both_ends(spark):
    df = spark.createDataFrame(
        [(at(s), at(0)) for s in (-301, -300, 0, 300, 301)], "a timestamp, b timestamp"
    ).coalesce(1)
    assert values(df, within(F.col("a"), F.col("b"), 300)) == [
        False,
        True,
        True,
        True,
        False,
    ]


def test_utc_stamp(spark):
    stamp = values(spark.range(1), utc_stamp())[0]
    assert stamp.endswith("+00:00") and "T" in stamp


def test_band_bounds(spark):
    metres = [1999, 2000, 4999, 5000, 9999, 10000, None]
    df = spark.createDataFrame([(m,) for m in metres], "v int").coalesce(1)
    assert values(df, VISIBILITY_BANDS.label("v")) == [
        "Poor (0-2km)",
        "Moderate (2-5km)",
        "Moderate (2-5km)",
        "Good (5-10km)",
        "Good (5-10km)",
        "Clear (10km+)",
        None,
    ]
    assert values(df, VISIBILITY_BANDS.rank("v")) == [0, 1, 1, 2, 2, 3, None]


@pytest.mark.parametrize(
    "bounds, labels", [((1, 2), ("a", "b")), ((2, 1), ("a", "b", "c"))]
)
def test_bands_are_checked(bounds, labels):
    with pytest.raises(ValueError):
        Bands(bounds, labels)


def test_least_row_puts_nulls_last(spark):
    df = spark.createDataFrame(
        [(1, None, 1), (1, "b", None), (1, "b", 7), (2, None, None)],
        "k int, s string, v int",
    )
    assert sorted(map(tuple, least_row(df, ["k"], ["s", "v"]).collect())) == [
        (1, "b", 7),
        (2, None, None),
    ]
