"""The history listing from a table's newest folders.

A listing of the first row of each key, newest first, needs the newest folders and
whatever shows which of their keys are older. Folders are read newest first. What
was read gives the first row of each key so far, a state that each further folder
is merged into. A key whose first row is later than all unread folders end, and
that no unread folder holds, is final, and no key of an unread folder can come
before it; so the listing ends with ``limit`` final keys. Whether an unread folder
holds a key is asked of its filter, and of its ids only where the filter says that
it may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contexture.operators.history import first_per_key, latest
from contexture.schemas import JOINED_TABLE
from contexture.session import shared_dir
from contexture.sources import pruning, tables

KEY, TIME = "t_id", "t_start"


def _newest_first(entries: list[dict]) -> list[dict]:
    """By end of the span; folders without one have to be read."""
    return sorted(entries, key=lambda e: e["span"][1] if e.get("span") else 1 << 62, reverse=True)


def _final(spark: SparkSession, base: str, firsts: DataFrame, unread: list[dict]) -> DataFrame:
    """First rows that no unread folder can change or come before."""
    if not unread:
        return firsts
    end = max(entry["span"][1] for entry in unread)
    found = firsts.where(F.unix_micros(TIME) > end)
    maybe = pruning.with_ids(spark, base, unread, found, KEY)
    if not maybe:
        return found
    older = tables._read(spark, base, JOINED_TABLE, maybe).select(F.col(KEY).alias("_older"))
    return found.join(older, F.col(KEY).eqNullSafe(F.col("_older")), "left_anti")


def history(spark: SparkSession, base: str, limit: int = 500) -> tuple[DataFrame, list[str]]:
    """``operators.history.history`` of the joined table, and the folders whose rows were read.

    The rows are written to the shared folder. Rows without an id are one key.
    """
    unread = _newest_first([e for e in tables.manifest(spark, base)[1]["folders"] if e["days"]])
    firsts = spark.createDataFrame([], JOINED_TABLE)
    read: list[str] = []
    step = 1
    while True:
        final = _final(spark, base, firsts, unread)
        found = latest(final, limit, TIME, KEY)
        path = shared_dir(spark, "history")
        found.write.parquet(path)
        rows = spark.read.schema(JOINED_TABLE).parquet(path)
        if not unread or rows.count() >= limit:
            return rows, read
        # As many again as were read: at most about twice as many as needed.
        more, unread = unread[:step], unread[step:]
        while unread and not unread[0].get("span"):
            more, unread = [*more, unread[0]], unread[1:]
        step *= 2
        read += [entry["folder"] for entry in more]
        added = tables._read(spark, base, JOINED_TABLE, more).drop(tables.DAY)
        firsts = first_per_key(firsts.unionByName(added), KEY, TIME)
        path = shared_dir(spark, "firsts")
        firsts.write.parquet(path)
        firsts = spark.read.schema(JOINED_TABLE).parquet(path)
