"""The stream's tail: incidents that a stopped query still holds, answered in batch.

A ``nearest`` stream answers a bucket when the watermark has passed it, so at the
end of a run the last buckets stay in state. ``tail`` reads that state from the
checkpoint of the stopped query: the incidents not yet answered, and the
observations of their buckets. Both go through the batch join, and the rows are
committed under an epoch of their own. The state is not touched. A later run that
goes on from the checkpoint answers these incidents again, and the table, which
knows its rows by content, leaves them out; they keep the answer they were given.

A ``first`` stream answers at once and holds nothing back.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contexture.functions.order import quoted
from contexture.operators.context import (
    BUCKET_SECONDS,
    CONTEXT_COLUMNS,
    TOLERANCE_SECONDS,
    context_join,
)
from contexture.operators.dedup import INCIDENT_KEY
from contexture.sources import storage
from contexture.sources.tables import write_epoch

#: Group keys of the two states a tail is made of, as the stream names them.
INCIDENT_STATE = ("bucket", "start_micros", "t_id")
OBSERVATION_STATE = ("bucket", "level", "node", "child")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the query whose checkpoint this is."""
    text = storage.read_text(spark, f"{checkpoint.rstrip('/')}/metadata")
    if text is None:
        raise FileNotFoundError(f"{checkpoint} is not a checkpoint of a query")
    return json.loads(text)["id"]


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """Number of the last batch the query has committed."""
    names = storage.names(spark, f"{checkpoint.rstrip('/')}/commits")
    return max((int(name) for name in names if name.isdigit()), default=-1)


def _operators(spark: SparkSession, checkpoint: str, name: str) -> list[int]:
    found = spark.read.format("state-metadata").load(checkpoint)
    found = found.where(F.col("operatorName") == name).select("operatorId").distinct()
    return sorted(row["operatorId"] for row in found.collect())


def states(spark: SparkSession, checkpoint: str, key: Sequence[str]) -> list[DataFrame]:
    """The aggregates held under these group keys, in the order of the query's operators."""
    out = []
    for operator in _operators(spark, checkpoint, "stateStoreSave"):
        rows = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
        if tuple(rows.schema["key"].dataType.names) == tuple(key):
            out.append(rows)
    return out


def _is_incident_state(rows: DataFrame, carried: Sequence[str]) -> bool:
    """Whether copies of incidents are brought to one here; answers have the same keys."""
    values = rows.schema["value"].dataType
    least = values["min"].dataType if "min" in values.names else None
    names = list(carried) or ["t_id"]
    # Each column comes behind a flag that says whether it is null.
    return least is not None and least.names[1::2] == names and len(least) == 2 * len(names)


def held_incidents(spark: SparkSession, checkpoint: str, carried: Sequence[str]) -> DataFrame:
    """Incidents not yet answered, with the ``carried`` columns.

    An incident whose bucket has been passed is on its way through the join; a
    query that has run to its end has none of these, and of another there is no tail.
    """
    found = states(spark, checkpoint, INCIDENT_STATE)
    own = [rows for rows in found if _is_incident_state(rows, carried)]
    if len(own) != 1:
        raise ValueError(f"{checkpoint} is not that of a 'nearest' stream with these columns")
    passing = [rows for rows in found if rows is not own[0]]
    for operator in _operators(spark, checkpoint, "symmetricHashJoin"):
        for side in ("left", "right"):
            state = spark.read.format("statestore").option("operatorId", operator)
            passing.append(state.option("joinSide", side).load(checkpoint))
    if not all(rows.isEmpty() for rows in passing):
        raise RuntimeError("rows are on their way: run the query to its end first")
    return own[0].select(
        F.timestamp_micros("key.start_micros").alias("t_start"),
        F.col("key.t_id").alias("t_id"),
        *[F.col(f"value.min.{quoted(c)}").alias(c) for c in carried],
    )


def held_observations(spark: SparkSession, checkpoint: str, context: Sequence[str]) -> DataFrame:
    """Observations of the buckets not yet answered that can be an answer.

    All instants of a bucket that incidents can lie in, and the ends of its neighbours. The
    first and the last observation of a slot are each the least of their instant.
    """
    (rows,) = states(spark, checkpoint, OBSERVATION_STATE)
    # First and last are both called min, so they are taken by place.
    names = [f"v{k}" for k in range(len(rows.schema["value"].dataType.names))]
    fields = ", ".join(
        f"{name}: {field.dataType.simpleString()}"
        for name, field in zip(names, rows.schema["value"].dataType.fields, strict=True)
    )
    rows = rows.select(F.expr(f"CAST(value AS STRUCT<{fields}>) AS ends")).where("ends.v0 IS NOT NULL")
    both = "array(ends.v0, struct(-ends.v1.key AS key, ends.v1.own AS own))"
    rows = rows.select(F.expr(f"explode({both}) AS seen")).select(
        F.timestamp_micros("seen.key").alias("w_timestamp"),
        *[F.col(f"seen.own.{quoted(c)}").alias(c) for c in context],
    )
    return rows.distinct()


def tail(
    spark: SparkSession,
    checkpoint: str,
    columns: Sequence[str],
    bucket_seconds: int | None = BUCKET_SECONDS,
    tolerance_seconds: int = TOLERANCE_SECONDS,
    context: Sequence[str] = CONTEXT_COLUMNS,
    required: str | None = "weather_desc",
) -> DataFrame:
    """The rows a ``nearest`` stream with these settings has not yet given.

    ``columns`` are those of its incidents. The query must not be running.
    """
    carried = [c for c in columns if c not in INCIDENT_KEY]
    return context_join(
        held_incidents(spark, checkpoint, carried).select(*columns),
        held_observations(spark, checkpoint, context),
        bucket_seconds,
        tolerance_seconds,
        context,
        required,
    )


def commit_tail(spark: SparkSession, checkpoint: str, table: str, rows: DataFrame) -> bool:
    """Adds the tail to the table; False if this was done since the last batch.

    Its epochs are those of a query of their own, so rows that a later run gives
    again are known as another query's.
    """
    name = f"{query_id(spark, checkpoint)}/tail"
    return write_epoch(rows, table, name, last_batch(spark, checkpoint), INCIDENT_KEY)
