from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from contexture.operators import cells, normalize

BOXES = [
    (10.0, 20.0, 0.5),
    (38.25, -90.5, 0.25),
    (0.0, 0.0, 0.0),
    (0.0, 180.0, 2.0),
    (0.0, -179.5, 3.0),
    (89.9, 5.0, 1.0),
    (-90.0, -180.0, 40.0),
    (3.0, 190.0, 15.0),
    (0.0, 0.0, 200.0),
]
EDGES = [0.0, -0.0, 90.0, -90.0, 180.0, -180.0, 20.5, 19.5, 10.5, 9.5, 179.9999999, -178.0]


def within(lat, lon, box):
    """By the distance around the globe."""
    if lat is None or lon is None or not (math.isfinite(lat) and -180 <= lon <= 180):
        return False
    latitude, longitude, offset = box
    if not latitude - offset <= lat <= latitude + offset:
        return False
    spans = cells.longitudes(longitude, offset)
    return any(a <= lon <= b for a, b in spans)


@pytest.fixture(scope="module")
def points():
    pick = random.Random(3)
    rows = [(pick.uniform(-90, 90), pick.uniform(-180, 180)) for _ in range(20_000)]
    rows += [(pick.choice(EDGES), pick.choice(EDGES)) for _ in range(400)]
    rows += [(None, 1.0), (1.0, None), (None, None), (math.nan, 20.0), (10.0, math.nan)]
    rows += [(math.inf, 20.0), (10.0, -math.inf), (95.0, 20.0), (10.0, 381.0)]
    rows += [(10.25, 20.25)] * 8000
    return [(n, *row) for n, row in enumerate(rows)]


@pytest.fixture(scope="module")
def stored(spark, points, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("points") / "p")
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    cells.write_points(df, path, files=24)
    return path


@pytest.mark.parametrize("box", BOXES)
def test_box_has_all_its_points(spark, points, stored, box):
    found = [row.id for row in cells.read_box(spark, stored, *box).collect()]
    assert sorted(found) == [n for n, lat, lon in points if within(lat, lon, box)]


def test_same_rows_as_the_plain_box(spark, points, stored):
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    for box in BOXES[:3]:
        plain = normalize.bounding_box(df, *box).collect()
        assert sorted(plain) == sorted(cells.read_box(spark, stored, *box).collect())


@pytest.mark.parametrize("most", [1, 2, 5, 16, 64])
def test_cover_holds_the_box_in_few_ranges(most):
    pick = random.Random(most)
    for _ in range(40):
        lat, lon = pick.uniform(-90, 90), pick.uniform(-180, 180)
        offset = 10 ** pick.uniform(-4, 2)
        spans = cells.longitudes(lon, offset)
        ranges = cells.cover(lat - offset, lat + offset, spans, most)
        assert 1 <= len(ranges) <= max(most, 1)
        assert all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))


def test_only_near_row_groups_are_read(spark, points, stored, check_plan):
    df = cells.read_box(spark, stored, 40.0, -100.0, 1.0)
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert 0 < read < len(points) / 5
    assert "GreaterThanOrEqual(cell" in check_plan(df)


def test_one_place_is_many_files(spark, stored):
    rows = spark.read.parquet(stored).where("lat = 10.25 AND lon = 20.25")
    sizes = rows.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) >= 4 and max(row["count"] for row in sizes) < 4000


def test_empty_and_clashing(spark, folder):
    none = spark.createDataFrame([], "lat double, lon double")
    path = folder("none")
    cells.write_points(none, path)
    assert cells.read_box(spark, path, 0.0, 0.0).collect() == []
    with pytest.raises(ValueError, match="cell"):
        cells.write_points(none.withColumn("Cell", F.lit(1)), folder("taken"))
    with pytest.raises(ValueError, match="finite"):
        cells.longitudes(math.nan, 1.0)
