"""What a table's folder may hold: its span of event times, and a filter over its ids.

Both are made from a folder once it is written and before it is listed. The span
stands in the manifest. The filter is a Bloom filter cut into pages of bits, a row
a page, in a small Parquet folder of its own: an id looks at one page of each
folder, whatever their size. Either can only say that rows are not there, so
folders are left out and none wrongly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "attempt"
#: Bits of a page, as Spark's bitmap aggregate has them.
PAGE_BITS = 32768
BITS_PER_ID = 12
HASHES = 6


def time_column(schema: T.StructType) -> str:
    """The event time of a table: its first timestamp."""
    return next(f.name for f in schema if isinstance(f.dataType, T.TimestampType))


def span_of(rows: DataFrame, time: str) -> tuple[list[int] | None, int]:
    """First and last event time in microseconds, null without rows, and the number of rows."""
    found = rows.agg(
        F.unix_micros(F.min(time)).alias("least"),
        F.unix_micros(F.max(time)).alias("most"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    return (None if found["least"] is None else [found["least"], found["most"]]), found["rows"]


def within(entries: Sequence[dict], least: int | None, most: int | None) -> list[dict]:
    """The folders whose span meets ``least`` to ``most``; a folder without one may."""
    kept = []
    for entry in entries:
        span = entry.get("span")
        before = span and least is not None and span[1] < least
        after = span and most is not None and span[0] > most
        if not (before or after):
            kept.append(entry)
    return kept


def _page(id_: str, pages: Column | int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(pages) if isinstance(pages, int) else pages)


def _bits(id_: str) -> Column:
    hashes = [F.pmod(F.xxhash64(id_, F.lit(k)), F.lit(PAGE_BITS)) for k in range(1, HASHES + 1)]
    return F.array(*hashes)


def write_filter(rows: DataFrame, id_: str, count: int, base: str, folder: str) -> dict:
    """The filter of ``count`` rows over their ``id_``; what the manifest says of it."""
    pages = 1
    while pages * PAGE_BITS < count * BITS_PER_ID:
        pages *= 2
    ids = rows.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id")).distinct()
    ids = ids.select(_page("id", pages).alias("page"), F.explode(_bits("id")).alias("bit"))
    made = ids.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    made.write.parquet(f"{base.rstrip('/')}/filters/{folder}")
    nulls = not rows.where(F.col(id_).isNull()).isEmpty()
    return {"column": id_, "pages": pages, "nulls": nulls}


def with_ids(
    spark: SparkSession, base: str, entries: Sequence[dict], ids: DataFrame, id_: str
) -> list[dict]:
    """The folders that may hold one of ``ids``, null among them; those without a filter may.

    Collected: the names of the folders, which the manifest lists anyway.
    """
    filtered = [e for e in entries if (e.get("filter") or {}).get("column") == id_]
    if not filtered:
        return list(entries)
    root = f"{base.rstrip('/')}/filters"
    schema = f"page bigint, bits binary, {FOLDER} string"
    pages = spark.read.schema(schema).option("basePath", root)
    pages = pages.parquet(*(f"{root}/{e['folder']}" for e in filtered))
    sizes = [(e["folder"].partition("=")[2], e["filter"]["pages"]) for e in filtered]
    sizes = spark.createDataFrame(sizes, f"{FOLDER} string, pages bigint")
    known = ids.select(F.col(id_).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    powers = sorted({e["filter"]["pages"] for e in filtered})  # a few powers of two
    known = known.select("id", F.explode(F.array(*(F.lit(p).cast("bigint") for p in powers))).alias("pages"))
    known = known.select("pages", _page("id", F.col("pages")).alias("page"), _bits("id").alias("wanted"))
    byte = "CAST(conv(hex(substring(bits, CAST(p DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    held = f"forall(wanted, p -> shiftright({byte}, CAST(p % 8 AS INT)) % 2 = 1)"
    found = pages.join(sizes, FOLDER).join(known, ["pages", "page"]).where(held)
    names = {f"{FOLDER}={row[0]}" for row in found.select(FOLDER).distinct().collect()}
    with_nulls = {e["folder"] for e in filtered if e["filter"]["nulls"]}
    if with_nulls and not ids.where(F.col(id_).isNull()).isEmpty():
        names |= with_nulls
    return [e for e in entries if e not in filtered or e["folder"] in names]
