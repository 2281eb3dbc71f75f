"""Messages that a stream would lose are kept, with the reason, and can be played again.

A gate stands between a topic and the queries on it. Each of its epochs parts
the messages: those that cannot be read, have no event time or lie behind the
watermark go to a quarantine table, all others are passed on to a topic of the
same form. The gate's watermark is the greatest event time of earlier epochs
less the delay, as a stateful query has it; it is written down by epoch, so an
epoch that is run again parts its messages alike.

A passed epoch appears whole, as one folder. A query behind the gate with the
same delay therefore drops nothing as late: what it has seen is some of the gate's
epochs, and no later epoch has a message behind these. That holds while
its batches take whole epochs (no ``files_per_batch``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from contexture import schemas
from contexture.functions.records import decode
from contexture.functions.times import OFFSET_PATTERN, epoch_to_timestamp, parse_time
from contexture.sources import storage, tables
from contexture.sources.topics import INCIDENT_TOPIC, WEATHER_TOPIC, FolderTopics, KafkaTopics

UNREADABLE, WITHOUT_TIME, LATE = "unreadable", "without_time", "late"
DELAY_SECONDS = 600

#: What was kept back: the message, why, and what the gate knew.
QUARANTINE = T.StructType(
    [
        T.StructField("kept_at", T.TimestampType()),
        T.StructField("value", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("watermark", T.TimestampType()),
        T.StructField("epoch", T.LongType()),
    ]
)


def event_time(topic: str, patterns: Sequence[str] = (OFFSET_PATTERN,)) -> Column:
    """The event time of a topic's messages."""
    value = F.col("value")
    if topic == WEATHER_TOPIC:
        return epoch_to_timestamp(decode(value, schemas.WEATHER_RECORD)["timestamp"])
    if topic == INCIDENT_TOPIC:
        return parse_time(decode(value, schemas.INCIDENT_RECORD)["start_time"], patterns)
    raise ValueError(f"the messages of {topic} are not known")


def parted(messages: DataFrame, time: Column, watermark_millis: int | None) -> DataFrame:
    """``value, event_time, reason``; the reason is null for messages that may pass.

    A message at the watermark is late, as it is to a stateful query.
    """
    text = F.col("value").cast("string")
    rows = messages.select(text.alias("value")).withColumn("event_time", time)
    late = F.lit(False)
    if watermark_millis is not None:
        late = F.unix_micros("event_time") <= F.lit(watermark_millis * 1000)
    reason = (
        F.when(F.try_parse_json("value").isNull(), UNREADABLE)
        .when(F.col("event_time").isNull(), WITHOUT_TIME)
        .when(late, LATE)
    )
    return rows.withColumn("reason", reason)


def _greatest_before(spark: SparkSession, marks: str, epoch: int) -> int | None:
    """Greatest event time, in milliseconds, of the epochs before this one."""
    found = [n for n in storage.names(spark, marks) if n < f"{epoch:012d}.json"]
    return json.loads(storage.read_text(spark, f"{marks}/{found[-1]}")) if found else None


def _pass_on(rows: DataFrame, folder: str, name: str) -> None:
    """The rows as a folder of text files that is there whole or not at all."""
    spark = rows.sparkSession
    if storage.exists(spark, f"{folder}/{name}"):
        return
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    rows.write.text(draft)
    if not storage.move(spark, draft, f"{folder}/{name}"):
        raise RuntimeError(f"{folder}/{name} could not be put in its place")


def start_gate(
    spark: SparkSession,
    topics: KafkaTopics | FolderTopics,
    topic: str,
    passed: FolderTopics,
    quarantine_path: str,
    checkpoint: str,
    delay_seconds: int = DELAY_SECONDS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the gate of one topic; what passes is read with ``passed``.

    ``passed`` must read nested folders. An epoch without messages to pass or to
    keep leaves no folder. Nothing is shuffled; a message is read once and its
    text written once, to one side or the other.
    """
    if not passed.nested:
        raise ValueError("passed messages lie in a folder an epoch: set nested")
    time = event_time(topic)
    marks = f"{quarantine_path.rstrip('/')}/marks"

    def split(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        query = tables.streaming_query_id(own)
        greatest = _greatest_before(own, f"{marks}/{query}", epoch)
        mark = None if greatest is None else greatest - delay_seconds * 1000
        # Summed up, passed on and kept back: parsed once.
        rows = parted(batch, time, mark).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = rows.agg(
                F.max(F.unix_millis("event_time")).alias("greatest"),
                F.count_if(F.col("reason").isNull()).alias("passed"),
                F.count_if(F.col("reason").isNotNull()).alias("kept"),
            ).first()
            if found["passed"]:
                name = f"epoch-{query}-{epoch:012d}"
                _pass_on(rows.where("reason IS NULL").select("value"), passed.path(topic), name)
            if found["kept"]:
                kept = rows.where("reason IS NOT NULL").select(
                    F.current_timestamp().alias("kept_at"),
                    "value",
                    "reason",
                    "event_time",
                    F.timestamp_millis(F.lit(mark).cast("bigint")).alias("watermark"),
                    F.lit(epoch).cast("bigint").alias("epoch"),
                )
                tables.write_epoch(kept, quarantine_path, query, epoch)
            known = [t for t in (greatest, found["greatest"]) if t is not None]
            if known:
                storage.write_text(own, f"{marks}/{query}/{epoch:012d}.json", json.dumps(max(known)))
        finally:
            rows.unpersist()

    writer = topics.read_stream(spark, topic).writeStream.foreachBatch(split)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_table(spark, path, QUARANTINE)


def replay(
    spark: SparkSession,
    quarantine_path: str,
    table: str,
    answer: Callable[[DataFrame], DataFrame],
    unique: Sequence[str],
    reasons: Sequence[str] = (LATE,),
) -> bool:
    """Add to ``table`` what messages in quarantine come to; False if that was done already.

    ``answer`` makes the table's rows from messages in ``value``. It may parse them
    with other patterns than the gate, which is how messages without a time come
    back. Rows that the table holds under the same ``unique`` columns are left out,
    those of earlier replays among them, so it can be called as often as one likes;
    several new ones of the same columns come to one. The messages stay in quarantine.
    """
    number = tables.manifest(spark, quarantine_path)[0]
    kept = read_quarantine(spark, quarantine_path).where(F.col("reason").isin(*reasons))
    rows = answer(kept.select("value")).dropDuplicates(list(unique))
    # Every replay is a query of its own: the table asks its other queries' rows.
    name = f"replay-{'-'.join(sorted(reasons))}-{number}"
    return tables.write_epoch(rows, table, name, 0, unique)
