"""Exact distinct counts over a growing table, without reading it again.

A ledger stands beside a table and holds the distinct (group, id) keys that it has
seen, and how many each group has. A refresh reads the folders that were listed
since the last one, keeps the keys that the ledger does not hold, and adds them
as a part of their own with its counts; a part appears with the next manifest of
the ledger, together with the number of the table's manifest it goes up to. So a
folder is folded once, a refresh that is run again finds nothing to do, and of two
at a time one begins anew. The answer is the sum of the parts' counts. Nothing but
the keys, two or three narrow columns, is ever joined.

A folder that replaces others keeps their number, so what was folded is not read
again after ``tables.compact``; if only some of them were, it is folded whole, and
the keys that are there already count once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contexture.functions.bands import VISIBILITY_BANDS, Bands
from contexture.operators import marts
from contexture.schemas import JOINED_TABLE, OBSERVATION_TABLE
from contexture.sources import storage, tables

KEY = "_key"
ATTEMPTS = 20
#: Parts beyond which a refresh merges all of them into one.
MOST_PARTS = 32


@dataclass(frozen=True)
class Counted:
    """What a ledger counts: distinct ``counted`` by ``group``, of rows ``where``.

    ``group`` has a column expression for each name. The name of the ledger stands
    for all of this: one that counts otherwise needs another name.
    """

    name: str
    counted: str
    group: Mapping[str, Column] = field(default_factory=dict)
    where: str = "true"


def _root(base: str, spec: Counted) -> str:
    return f"{base.rstrip('/')}/ledgers/{spec.name}"


def manifest(spark: SparkSession, base: str, spec: Counted) -> tuple[int, dict]:
    """Number and content of the newest manifest: ``through`` and ``parts``."""
    folder = f"{_root(base, spec)}/manifests"
    found = [name for name in storage.names(spark, folder) if name.endswith(".json")]
    if not found:
        return 0, {"through": -1, "parts": []}
    text = storage.read_text(spark, f"{folder}/{found[-1]}")
    return int(found[-1].removesuffix(".json")), json.loads(text)


def _parts(spark: SparkSession, base: str, spec: Counted, parts: list[str], kind: str) -> DataFrame:
    return spark.read.parquet(*(f"{_root(base, spec)}/parts/{part}/{kind}" for part in parts))


def _write_part(keys: DataFrame, base: str, spec: Counted) -> str:
    """A new part, not yet listed: keys, and of each group how many are not null."""
    spark, part = keys.sparkSession, uuid.uuid4().hex
    path = f"{_root(base, spec)}/parts/{part}"
    keys.write.parquet(f"{path}/keys")
    counts = spark.read.schema(keys.schema).parquet(f"{path}/keys").groupBy(*spec.group)
    counts.agg(F.count(KEY).alias("n")).write.parquet(f"{path}/counts")
    return part


def new_folders(spark: SparkSession, base: str, through: int) -> tuple[list[dict], int]:
    """Folders listed after manifest ``through``, and the number they go up to."""
    listed = [e for e in tables.manifest(spark, base)[1]["folders"] if e["days"]]
    found = [e for e in listed if e.get("at", 0) > through]
    return found, max((e.get("at", 0) for e in found), default=through)


def refresh(spark: SparkSession, base: str, schema: T.StructType, spec: Counted) -> DataFrame:
    """``n`` by group for the table as it is listed now; folds what is new."""
    for _ in range(ATTEMPTS):
        number, content = manifest(spark, base, spec)
        parts = content["parts"]
        folders, through = new_folders(spark, base, content["through"])
        if not folders:
            break
        rows = tables._read(spark, base, schema, folders).where(spec.where)
        keys = rows.select(
            *[expression.alias(name) for name, expression in spec.group.items()],
            F.col(spec.counted).alias(KEY),
        ).distinct()
        if parts:
            held = _parts(spark, base, spec, parts, "keys")
            held = held.select(*(F.col(c).alias(f"_held_{c}") for c in keys.columns))
            same = [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in keys.columns]
            keys = keys.join(held, same, "left_anti")
        if len(parts) >= MOST_PARTS:
            keys, parts = keys.unionByName(_parts(spark, base, spec, parts, "keys")), []
        content = {"through": through, "parts": [*parts, _write_part(keys, base, spec)]}
        path = f"{_root(base, spec)}/manifests/{number + 1:012d}.json"
        if storage.write_text(spark, path, json.dumps(content)):
            parts = content["parts"]
            break
    else:
        raise RuntimeError(f"{base}: others kept refreshing {spec.name}")
    if not parts:
        names = [T.StructField(name, T.StringType()) for name in spec.group]
        return spark.createDataFrame([], T.StructType([*names, T.StructField("n", T.LongType())]))
    counts = _parts(spark, base, spec, parts, "counts").groupBy(*spec.group)
    return counts.agg(F.sum("n").cast("bigint").alias("n"))


def drop_unlisted(spark: SparkSession, base: str, spec: Counted) -> int:
    """Remove parts that the newest manifest does not list, and older manifests.

    Run it while nobody refreshes or reads the ledger.
    """
    number, content = manifest(spark, base, spec)
    root = _root(base, spec)
    gone = [p for p in storage.names(spark, f"{root}/parts") if p not in content["parts"]]
    for part in gone:
        storage.delete(spark, f"{root}/parts/{part}")
    for name in storage.names(spark, f"{root}/manifests"):
        if name.endswith(".json") and int(name.removesuffix(".json")) < number:
            storage.delete(spark, f"{root}/manifests/{name}")
    return len(gone)


# The marts of ``operators.marts``, from ledgers


def _by(name: str, counted: str, *columns: str, where: str = "true") -> Counted:
    return Counted(name, counted, {c: F.col(c) for c in columns}, where)


def _by_band(name: str, counted: str, bands: Bands) -> Counted:
    group = {"bucket_rank": bands.rank("visibility")}
    return Counted(name, counted, group, "visibility IS NOT NULL")


def rate_by_context(spark: SparkSession, joined: str, observations: str) -> DataFrame:
    """``marts.rate_by_context`` of both tables as they are now."""
    observed = refresh(
        spark, observations, OBSERVATION_TABLE, _by("instants", "w_timestamp", "weather_desc")
    )
    counted = refresh(spark, joined, JOINED_TABLE, _by("incidents", "t_id", "weather_desc"))
    return marts.rates(
        observed.withColumnRenamed("n", "_observed"),
        counted.withColumnRenamed("n", "_incidents"),
        "weather_desc",
    )


def rate_by_bucket(
    spark: SparkSession, joined: str, observations: str, bands: Bands = VISIBILITY_BANDS
) -> DataFrame:
    """``marts.rate_by_bucket`` of both tables as they are now, in no order."""
    observed = refresh(
        spark, observations, OBSERVATION_TABLE, _by_band("band-instants", "w_timestamp", bands)
    )
    counted = refresh(spark, joined, JOINED_TABLE, _by_band("band-incidents", "t_id", bands))
    return marts.band_rates(
        observed.withColumnRenamed("n", "minute_count"),
        counted.withColumnRenamed("n", "incident_count"),
        bands,
    )


def severity_by_context(spark: SparkSession, joined: str) -> DataFrame:
    """``marts.severity_by_context`` of the table as it is now, in no order."""
    known = "t_severity IS NOT NULL AND weather_desc IS NOT NULL"
    spec = _by("severities", "t_id", "weather_desc", "t_severity", where=known)
    return refresh(spark, joined, JOINED_TABLE, spec).withColumnRenamed("n", "incident_count")


def severity_pivot(spark: SparkSession, joined: str) -> DataFrame:
    """A column for every severity that the table's manifest lists."""
    counts = severity_by_context(spark, joined)
    return marts.pivoted(counts, severities=tables.listed_values(spark, joined), other=None)
