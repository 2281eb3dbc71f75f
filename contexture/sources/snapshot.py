"""The live snapshot: three small tables that lapse after a while.

It describes the last non-empty micro-batch alone. Every snapshot has a folder of
its own, and one empty file whose name says that all its parts are there; a
reader takes the newest of these names once and reads all parts from that folder,
so parts of two snapshots never mix, and the folder being read is not written to.

A snapshot that belongs to a table is prepared first, named in the manifest of the
epoch whose rows it shows, and published then: what fails to reach the table is never
shown. A reader that names the table goes by its manifest, and so sees rows and
snapshot of one commit.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contexture import schemas
from contexture.operators.history import latest
from contexture.operators.marts import count_by_context
from contexture.sources import storage, tables

TTL_SECONDS = 300
RECENT_ROWS = 100
KEPT = 2

_PARTS = {
    "recent_incidents": schemas.SNAPSHOT_RECENT,
    "incident_counts": schemas.SNAPSHOT_COUNTS,
    "last_update": schemas.SNAPSHOT_UPDATE,
}


@dataclass(frozen=True)
class Snapshot:
    recent: DataFrame
    counts: DataFrame
    last_update: str | None
    error: str | None = None


def write_snapshot(
    batch: DataFrame,
    path: str,
    epoch_id: int,
    ttl_seconds: int = TTL_SECONDS,
    rows: int = RECENT_ROWS,
    now: datetime | None = None,
) -> None:
    """Replace the snapshot by that of ``batch``."""
    place = prepare_snapshot(batch, path, epoch_id, ttl_seconds, rows, now)
    publish_snapshot(batch.sparkSession, path, place)


def prepare_snapshot(
    batch: DataFrame,
    path: str,
    epoch_id: int,
    ttl_seconds: int = TTL_SECONDS,
    rows: int = RECENT_ROWS,
    now: datetime | None = None,
) -> str:
    """The snapshot of ``batch`` under a name that no reader goes by yet.

    The batch is worked out before the time is taken, so its own running time is
    not taken off the time to live; the caller keeps it persisted. Counts include
    the null label.
    """
    spark = batch.sparkSession
    base = path.rstrip("/")
    name = uuid.uuid4().hex
    parts = {
        "recent_incidents": latest(batch, rows),
        "incident_counts": count_by_context(batch, keep_null=True, name="count"),
    }
    for part, table in parts.items():
        table.write.parquet(f"{base}/drafts/{name}/{part}")
    now = now or datetime.now(timezone.utc)
    stamps = {
        "updated_at": F.lit(now),
        "expires_at": F.lit(now + timedelta(seconds=ttl_seconds)),
    }
    # Names ascend with time; the epoch tells equal times apart.
    place = f"{int(now.timestamp() * 1e6):020d}-{epoch_id:012d}-{name}"
    update = spark.range(0, 1, 1, 1).select(F.lit(now.isoformat()).alias("last_update_ts"))
    for part in parts:
        draft = spark.read.parquet(f"{base}/drafts/{name}/{part}")
        draft.withColumns(stamps).write.parquet(f"{base}/data/{place}/{part}")
    update.withColumns(stamps).write.parquet(f"{base}/data/{place}/last_update")
    storage.delete(spark, f"{base}/drafts/{name}")
    return place


def publish_snapshot(spark: SparkSession, path: str, place: str) -> None:
    """Show a prepared snapshot; older ones, and what was never shown, are removed."""
    base = path.rstrip("/")
    storage.write_text(spark, f"{base}/live/{place}", "")
    shown = storage.names(spark, f"{base}/live")
    for old in shown[:-KEPT]:
        storage.delete(spark, f"{base}/live/{old}")
    for old in storage.names(spark, f"{base}/data"):
        if old < shown[-KEPT:][0]:
            storage.delete(spark, f"{base}/data/{old}")


def read_snapshot(
    spark: SparkSession, path: str, now: datetime | None = None, table: str | None = None
) -> Snapshot:
    """The newest snapshot that has not lapsed; its parts are empty if none.

    With ``table`` it is the one that the table's manifest names.

    A snapshot of which any part cannot be read gives empty parts and the reason;
    all parts are small and are read once to find out. Without ``now`` the parts
    go empty by themselves when their time is over.
    """
    base = path.rstrip("/")
    moment = F.lit(now) if now else F.current_timestamp()

    def part(place: str, name: str, schema: T.StructType) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{base}/data/{place}/{name}")
        rows.write.format("noop").mode("overwrite").save()
        return rows.filter(F.col("expires_at") > moment)

    parts = {name: spark.createDataFrame([], schema) for name, schema in _PARTS.items()}
    stamp, error = None, None
    try:
        if table:
            named = tables.manifest(spark, table)[1].get("snapshot")
            places = [named] if named else []
        else:
            places = storage.names(spark, f"{base}/live")
        if places:
            found = {name: part(places[-1], name, schema) for name, schema in _PARTS.items()}
            stamp = found["last_update"].first()
            parts = found
    except Exception as reason:  # noqa: BLE001 - told to the reader, not raised
        error = str(reason)
    return Snapshot(
        parts["recent_incidents"],
        parts["incident_counts"],
        stamp["last_update_ts"] if stamp else None,
        error,
    )
