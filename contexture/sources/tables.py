"""The joined and the observation table: Parquet by event day, listed in a manifest.

A micro-batch is written to a folder of its own, cut by ``event_day``, and then
appears in the next manifest, one small file that lists all folders of the
table. A reader goes by the newest manifest, so it sees a batch whole or not at
all. A batch that is run again finds itself listed and writes nothing; what a
failed attempt left is listed nowhere. ``compact`` replaces the folders of past
days by one and keeps what it knows of their batches.

The manifest also has each folder's span of event times, and says where a filter
over its ids is (``pruning``); readers by time or id leave folders out before
they are listed. It has the severities of each folder, which are the columns of a
pivot, and the number of the manifest that first had its rows, by which a reader
knows what it has not seen yet (``ledger``).

The query id is kept in the checkpoint: a new checkpoint begins new numbers and may
begin its topics anew. Rows are therefore also known by content: a batch that
names its ``unique`` columns leaves out rows that folders of other queries hold
already. Those of its own query are not asked, as its state sees to them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contexture.operators import marts
from contexture.schemas import JOINED_TABLE, OBSERVATION_TABLE
from contexture.sources import pruning, storage
from contexture.sources.pruning import FOLDER, time_column

JOINED_VIEW = "weather_traffic_comb"
OBSERVATION_VIEW = "weather_duration"
RATE_VIEW = "incident_rate_by_context"
BUCKET_VIEW = "incident_rate_by_bucket"

DAY = "event_day"
ID = "t_id"
#: Column whose values the manifest lists, and how many it lists of a folder at most.
LISTED = "t_severity"
MOST_VALUES = 10_000
ATTEMPTS = 20
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def streaming_query_id(spark: SparkSession) -> str:
    """Id of the streaming query whose batch function is being run."""
    found = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise RuntimeError("there is no streaming query on this thread")
    return found


def manifest(spark: SparkSession, base: str) -> tuple[int, dict]:
    """Number and content of the newest manifest: ``folders`` and ``done``.

    ``done`` has the last listed epoch of each query.
    """
    folder = f"{base.rstrip('/')}/manifests"
    found = [name for name in storage.names(spark, folder) if name.endswith(".json")]
    if not found:
        return 0, {"folders": [], "done": {}}
    return int(found[-1].removesuffix(".json")), json.loads(
        storage.read_text(spark, f"{folder}/{found[-1]}")
    )


def _commit(spark: SparkSession, base: str, number: int, content: dict) -> bool:
    path = f"{base.rstrip('/')}/manifests/{number:012d}.json"
    return storage.write_text(spark, path, json.dumps(content))


def _write(rows: DataFrame, base: str) -> dict:
    """A new folder of rows, not yet listed: its days, span of times and filter."""
    spark = rows.sparkSession
    folder = f"{FOLDER}={uuid.uuid4().hex}"
    time = time_column(rows.schema)
    path = f"{base.rstrip('/')}/data/{folder}"
    rows.withColumn(DAY, F.to_date(time)).write.partitionBy(DAY).parquet(path)
    days = [
        name.partition("=")[2]
        for name in storage.names(spark, path)
        if name.startswith(f"{DAY}=")
    ]
    entry = {"folder": folder, "days": [min(days), max(days)] if days else None}
    if days:
        found = spark.read.schema(rows.schema).parquet(path)
        entry["span"], entry["rows"] = pruning.span_of(found, time)
        if ID in rows.columns:
            entry["filter"] = pruning.write_filter(found, ID, entry["rows"], base, folder)
        if LISTED in rows.columns:
            entry["values"] = _values(found, LISTED)
    return entry


def _values(rows: DataFrame, column: str) -> list[str] | None:
    """The distinct values of a folder, none if they are too many for columns of a table."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct()
    listed = [row[0] for row in found.limit(MOST_VALUES + 1).collect()]
    return sorted(listed) if len(listed) <= MOST_VALUES else None


def _unknown(
    batch: DataFrame, base: str, entries: list[dict], unique: Sequence[str]
) -> tuple[DataFrame, set[str]]:
    """Rows of ``batch`` that the folders do not hold, and the folders this holds for.

    Only folders that may hold such rows are read, and of these the ``unique``
    columns and the days of the batch.
    """
    spark = batch.sparkSession
    asked = {e["folder"] for e in entries}
    time = time_column(batch.schema)
    span, _ = pruning.span_of(batch, time)
    entries = pruning.within(entries, *span) if span else []
    if entries and ID in unique:
        entries = pruning.with_ids(spark, base, entries, batch.select(ID), ID)
    if not entries:
        return batch, asked
    stored = _between(_read(spark, base, batch.schema, entries), time, *map(_moment, span))
    stored = stored.select(*(F.col(c).alias(f"_stored_{c}") for c in unique)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_stored_{c}")) for c in unique]
    return batch.join(stored, same, "left_anti"), asked


def write_epoch(
    batch: DataFrame,
    base: str,
    query_id: str,
    epoch_id: int,
    unique: Sequence[str] | None = None,
    snapshot: str | None = None,
) -> bool:
    """Add one micro-batch; False if it is listed already. An error reaches the caller.

    With ``unique``, rows that another query's folders hold are left out. The name of
    a prepared ``snapshot`` appears with the rows.
    """
    spark = batch.sparkSession
    entry, asked = None, set()
    for _ in range(ATTEMPTS):
        number, content = manifest(spark, base)
        if content["done"].get(query_id, -1) >= epoch_id:
            return False
        others = [e for e in content["folders"] if unique and e["query"] != query_id]
        if entry is None or not {e["folder"] for e in others} <= asked:
            rows, asked = _unknown(batch, base, others, unique or [])
            entry = _write(rows, base)
        if entry["days"]:
            content["folders"].append(
                entry | {"query": query_id, "epoch": epoch_id, "at": number + 1}
            )
        content["done"][query_id] = epoch_id
        if snapshot:
            content["snapshot"] = snapshot
        if _commit(spark, base, number + 1, content):
            return True
    raise RuntimeError(f"{base}: others kept writing manifests")


def compact(
    spark: SparkSession, base: str, schema: T.StructType, before: date, files_per_day: int = 1
) -> bool:
    """Replace the folders whose days all lie before ``before`` by one folder.

    The old folders stay for readers that hold them; ``drop_unlisted`` removes
    them later. False if there is nothing to do or another writer came first.
    """
    number, content = manifest(spark, base)
    closed = [e for e in content["folders"] if e["days"] and e["days"][1] < before.isoformat()]
    if len(closed) < 2:
        return False
    rows = _read(spark, base, schema, closed)
    entry = _write(rows.repartition(F.col(DAY), F.floor(F.rand(0) * files_per_day)).drop(DAY), base)
    kept = [e for e in content["folders"] if e not in closed]
    known = max(e.get("at", 0) for e in closed)
    content["folders"] = [entry | {"query": None, "epoch": None, "at": known}, *kept]
    return _commit(spark, base, number + 1, content)


def drop_unlisted(spark: SparkSession, base: str, keep_manifests: int = 10) -> int:
    """Remove folders that none of the newest manifests lists, and older manifests.

    Run it while nothing is being written, or long after: a folder being written
    is not listed yet.
    """
    root = base.rstrip("/")
    names = [n for n in storage.names(spark, f"{root}/manifests") if n.endswith(".json")]
    listed = set()
    for name in names[-keep_manifests:]:
        content = json.loads(storage.read_text(spark, f"{root}/manifests/{name}"))
        listed |= {entry["folder"] for entry in content["folders"]}
    for name in names[:-keep_manifests]:
        storage.delete(spark, f"{root}/manifests/{name}")
    gone = [name for name in storage.names(spark, f"{root}/data") if name not in listed]
    for name in gone:
        storage.delete(spark, f"{root}/data/{name}")
        storage.delete(spark, f"{root}/filters/{name}")
    return len(gone)


def _read(spark: SparkSession, base: str, schema: T.StructType, entries: list[dict]) -> DataFrame:
    root = f"{base.rstrip('/')}/data"
    paths = [f"{root}/{entry['folder']}" for entry in entries if entry["days"]]
    days = T.StructField(DAY, T.DateType())
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, days]))
    found = T.StructType([*schema.fields, T.StructField(FOLDER, T.StringType()), days])
    return spark.read.schema(found).option("basePath", root).parquet(*paths).drop(FOLDER)


def listed_values(spark: SparkSession, base: str) -> list[str]:
    """All severities of the table, from its manifest."""
    found: set[str] = set()
    for entry in manifest(spark, base)[1]["folders"]:
        if entry["days"]:
            if entry.get("values") is None:
                raise ValueError(f"the values of {entry['folder']} are not listed")
            found |= set(entry["values"])
    return sorted(found)


def _moment(micros: int) -> datetime:
    return EPOCH + timedelta(microseconds=micros)


def _micros(moment: datetime | None) -> int | None:
    return None if moment is None else (moment - EPOCH) // timedelta(microseconds=1)


def _between(
    rows: DataFrame, time: str, since: datetime | None, until: datetime | None
) -> DataFrame:
    """Rows of the days and times asked for, ends included."""
    for limit, keep in ((since, lambda c, v: c >= v), (until, lambda c, v: c <= v)):
        if limit is not None:
            day = limit.astimezone(timezone.utc).date()
            rows = rows.where(keep(F.col(DAY), F.lit(day)) & keep(F.col(time), F.lit(limit)))
    return rows


def folders(
    spark: SparkSession,
    base: str,
    since: datetime | None = None,
    until: datetime | None = None,
    ids: DataFrame | None = None,
) -> list[dict]:
    """The listed folders that may hold rows of these times and of these ``t_id``."""
    listed = [e for e in manifest(spark, base)[1]["folders"] if e["days"]]
    found = pruning.within(listed, _micros(since), _micros(until))
    return found if ids is None else pruning.with_ids(spark, base, found, ids, ID)


def read_table(
    spark: SparkSession,
    base: str,
    schema: T.StructType,
    since: datetime | None = None,
    until: datetime | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """The rows listed now; a table not yet written is empty.

    ``since`` and ``until`` bound the event time, ends included; ``ids`` has the
    wanted ``t_id`` and is read to find their folders. Folders that cannot hold
    such rows are not listed, and other days not read.
    """
    since, until = (
        limit.replace(tzinfo=timezone.utc) if limit and not limit.tzinfo else limit
        for limit in (since, until)
    )
    rows = _read(spark, base, schema, folders(spark, base, since, until, ids))
    rows = _between(rows, time_column(schema), since, until).select(*schema.fieldNames())
    return rows if ids is None else rows.join(ids.select(ID).distinct(), ID, "left_semi")


def read_joined(
    spark: SparkSession, base: str, ids: DataFrame | None = None, **bounds: datetime | None
) -> DataFrame:
    return read_table(spark, base, JOINED_TABLE, ids=ids, **bounds)


def read_observations(spark: SparkSession, base: str, **bounds: datetime | None) -> DataFrame:
    return read_table(spark, base, OBSERVATION_TABLE, **bounds)


def register_views(
    spark: SparkSession, joined_path: str, observations_path: str
) -> None:
    """Both tables as they stand now under their SQL names, and their rates.

    A view keeps to the manifest of its registration; ``run_sql`` registers anew
    before each text. The rate views count each side before they join, which a
    plain join of the two tables by label would not.
    """
    joined = read_joined(spark, joined_path)
    observed = read_observations(spark, observations_path)
    joined.createOrReplaceTempView(JOINED_VIEW)
    observed.createOrReplaceTempView(OBSERVATION_VIEW)
    marts.rate_by_context(observed, joined).createOrReplaceTempView(RATE_VIEW)
    marts.rate_by_bucket(observed, joined, ordered=False).createOrReplaceTempView(BUCKET_VIEW)


def run_sql(
    spark: SparkSession, text: str, joined_path: str, observations_path: str
) -> DataFrame:
    """SQL text over both tables with all batches that are there now."""
    register_views(spark, joined_path, observations_path)
    return spark.sql(text)


def reset(spark: SparkSession, *paths: str) -> None:
    """Remove tables and checkpoints together.

    Clearing one table alone would leave rates with half their input.
    """
    for path in paths:
        storage.delete(spark, path)
