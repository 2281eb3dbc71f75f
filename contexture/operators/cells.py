"""Boxes on the globe over points stored by cell.

A cell is a square of a quadtree over longitude and latitude; its number
interleaves the bits of both, so points that are close have close numbers mostly.
Points written in the order of their cells lie in files and row groups of few
cells each. A box is covered by a few ranges of numbers, which the Parquet reader
holds against each row group's least and greatest cell, and the exact test on the
coordinates follows. The cover depends on the box alone, never on the rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each coordinate: a cell is about a metre wide.
LEVEL = 25
#: Ranges that cover a box; more of them read fewer points beyond it.
RANGES = 16
CELL = "cell"

#: Steps that move the bits of a number apart, one free place after each.
_SPREAD = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _place(degrees: float, least: float, span: float) -> int:
    """Row or column of a coordinate, as ``cell`` has it."""
    side = 1 << LEVEL
    return min(max(math.floor((degrees - least) / span * side), 0), side - 1)


def _place_of(degrees: Column, least: float, span: float) -> Column:
    side = 1 << LEVEL
    place = F.floor((degrees.cast("double") - F.lit(least)) / F.lit(span) * F.lit(float(side)))
    return F.least(F.greatest(place, F.lit(0)), F.lit(side - 1)).cast("bigint")


def _spread(place: Column) -> Column:
    for bits, mask in _SPREAD:
        place = place.bitwiseOR(F.shiftleft(place, bits)).bitwiseAND(F.lit(mask))
    return place


def cell(lat: Column, lon: Column) -> Column:
    """Number of the cell of a point; null if a coordinate is null.

    Coordinates beyond the globe count to the cells at its edge.
    """
    x, y = _place_of(lon, -180.0, 360.0), _place_of(lat, -90.0, 180.0)
    number = _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))
    return F.when(lat.isNotNull() & lon.isNotNull(), number)


def write_points(
    points: DataFrame, path: str, lat: str = "lat", lon: str = "lon", files: int | None = None
) -> None:
    """``points`` in the order of their cells, with the cell as a further column.

    Cut into ranges of cells, and within a cell at random, so that one place with
    a third of all points is many files.
    """
    if CELL in (name.lower() for name in points.columns):
        raise ValueError(f"the points have a column {CELL} already")
    rows = points.withColumn(CELL, cell(F.col(lat), F.col(lon)))
    cut = [F.col(CELL), F.rand(0)]
    rows = rows.repartitionByRange(files, *cut) if files else rows.repartitionByRange(*cut)
    rows.sortWithinPartitions(CELL).write.parquet(path)


def longitudes(longitude: float, offset: float) -> list[tuple[float, float]]:
    """The spans between -180 and 180 that lie within ``offset`` degrees around the globe.

    The two ends are one meridian, so a span that touches one has the other too.
    """
    if not (math.isfinite(longitude) and offset >= 0):
        raise ValueError("a box has a finite longitude and an offset that is not negative")
    if offset >= 180:
        return [(-180.0, 180.0)]
    if not -180 <= longitude <= 180:
        longitude = math.remainder(longitude, 360)
    low, high = longitude - offset, longitude + offset
    spans = [(max(low, -180.0), min(high, 180.0))]
    if low <= -180:
        spans.append((low + 360, 180.0))
    if high >= 180:
        spans.append((-180.0, high - 360))
    return spans


def cover(
    south: float, north: float, spans: list[tuple[float, float]], most: int = RANGES
) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cells that hold all points of the boxes, ends included.

    The quadtree is gone down level by level; squares that lie within a box are
    kept as they are, and the others split while there is room for their parts.
    """
    rows = _place(south, -90.0, 180.0), _place(north, -90.0, 180.0)
    boxes = [(_place(w, -180.0, 360.0), _place(e, -180.0, 360.0)) for w, e in spans]
    inside: list[tuple[int, int]] = []
    open_ = [(0, 0, 0)]
    for level in range(LEVEL + 1):
        shift = LEVEL - level
        cut = []
        for number, x, y in open_:
            first = number << 2 * shift
            low, high = (x << shift, y << shift), ((x + 1 << shift) - 1, (y + 1 << shift) - 1)
            if high[1] < rows[0] or low[1] > rows[1]:
                continue
            met = [b for b in boxes if high[0] >= b[0] and low[0] <= b[1]]
            if not met:
                continue
            whole = rows[0] <= low[1] and high[1] <= rows[1]
            if whole and any(b[0] <= low[0] and high[0] <= b[1] for b in met):
                inside.append((first, first + (1 << 2 * shift) - 1))
            else:
                cut.append((number, x, y))
        ranges = _joined(
            inside + [(n << 2 * shift, (n + 1 << 2 * shift) - 1) for n, _, _ in cut]
        )
        if level and len(ranges) > most:
            return found
        found = ranges
        if not cut:
            break
        open_ = [
            (number << 2 | b << 1 | a, x << 1 | a, y << 1 | b)
            for number, x, y in cut
            for b in (0, 1)
            for a in (0, 1)
        ]
    return found


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch made one."""
    found: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if found and first <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(found[-1][1], last))
        else:
            found.append((first, last))
    return found


def read_box(
    spark: SparkSession,
    path: str,
    latitude: float,
    longitude: float,
    offset: float = 0.5,
    lat: str = "lat",
    lon: str = "lon",
    ranges: int = RANGES,
) -> DataFrame:
    """Points of ``path`` within ``offset`` degrees of a point, edges included.

    A box over the date line goes on at the other side. Points with a null or no
    number for a coordinate, or a longitude beyond 180 degrees, are in no box.
    """
    south, north = latitude - offset, latitude + offset
    spans = longitudes(longitude, offset)
    near = [F.col(CELL).between(*r) for r in cover(south, north, spans, ranges)]
    exact = [F.col(lon).between(*span) for span in spans]
    rows = spark.read.parquet(path).where(reduce(Column.__or__, near))
    rows = rows.where(F.col(lat).between(south, north) & reduce(Column.__or__, exact))
    return rows.drop(CELL)
