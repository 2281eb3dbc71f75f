"""Topics to tables: two independent queries, each with its own checkpoint."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from contexture.operators.context import BUCKET_SECONDS, CONTEXT_COLUMNS, TOLERANCE_SECONDS
from contexture.operators.dedup import INCIDENT_KEY, OBSERVATION_KEY
from contexture.schemas import JOINED_TABLE
from contexture.sources import storage
from contexture.sources.snapshot import (
    RECENT_ROWS,
    TTL_SECONDS,
    prepare_snapshot,
    publish_snapshot,
)
from contexture.sources.tables import manifest, reset, streaming_query_id, write_epoch
from contexture.sources.topics import (
    INCIDENT_TOPIC,
    WEATHER_TOPIC,
    FolderTopics,
    KafkaTopics,
)
from contexture.streaming import drain, intake
from contexture.streaming.join import default_salts, stream_context_join

log = logging.getLogger(__name__)

AVAILABLE_NOW = {"availableNow": True}
ROWS_PER_FILE = 1_000_000
#: Records on the topics have times in whole seconds.
RECORD_TICK = 1_000_000
#: How a ``nearest`` stream lays out its slots; state of another layout cannot be gone on with.
SLOT_LAYOUT = 2


@dataclass(frozen=True)
class PipelineConfig:
    """Where the pipeline reads and writes, and how it matches.

    ``since`` leaves out incidents that started earlier. It belongs to the
    configuration, so a restart takes up the backlog of the downtime.
    ``trigger`` is passed to the stream writer; empty means as fast as
    possible. ``combine_copies`` is for micro-batches that one key makes up a
    large part of (see ``intake.combine_copies``). ``salts`` is fixed by the first
    run on a checkpoint, as the state is laid out by it, and so is ``tick_micros``, what
    event times are multiples of. ``finish`` is for runs that
    end: what a ``nearest`` stream then still holds is answered in batch (``drain``).
    """

    joined_path: str
    observations_path: str
    checkpoint_path: str
    snapshot_path: str | None = None
    since: datetime | None = None
    delay: str = intake.WATERMARK_DELAY
    match: str = "first"
    bucket_seconds: int | None = BUCKET_SECONDS
    tolerance_seconds: int = TOLERANCE_SECONDS
    salts: int | None = None
    tick_micros: int = RECORD_TICK
    combine_copies: bool = False
    finish: bool = False
    snapshot_ttl_seconds: int = TTL_SECONDS
    snapshot_rows: int = RECENT_ROWS
    trigger: dict = field(default_factory=dict)

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoint_path.rstrip('/')}/{name}"


def joined_stream(
    spark: SparkSession, topics: KafkaTopics | FolderTopics, config: PipelineConfig
) -> DataFrame:
    # The nearest match picks among all copies itself.
    combine = config.combine_copies and config.match == "first"
    incidents = intake.incidents_from_topic(
        topics.read_stream(spark, INCIDENT_TOPIC), config.since, config.delay, combine
    )
    observations = intake.weather_from_topic(
        topics.read_stream(spark, WEATHER_TOPIC), config.delay, combine
    )
    joined = stream_context_join(
        incidents,
        observations,
        config.match,
        config.bucket_seconds,
        config.tolerance_seconds,
        salts=config.salts or default_salts(spark),
        tick_micros=config.tick_micros,
    )
    return joined.select(*JOINED_TABLE.fieldNames())


def observations_stream(
    spark: SparkSession, topics: KafkaTopics | FolderTopics, config: PipelineConfig
) -> DataFrame:
    observations = intake.weather_from_topic(
        topics.read_stream(spark, WEATHER_TOPIC), config.delay
    )
    return intake.distinct_observation_stream(observations)


def table_writer(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    config: PipelineConfig | None = None,
    unique: Sequence[str] | None = None,
) -> DataStreamWriter:
    """Append the non-empty micro-batches of ``rows`` to the table at ``path``.

    Rows that another query's epochs hold under the same ``unique`` columns are
    left out, so a new checkpoint that begins its topics anew adds nothing twice.
    With a ``config`` that names a snapshot, each of them also replaces the
    snapshot, in the same commit. A failed write fails the query: the epoch is then run again from
    the checkpoint instead of being lost.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        # Counted, summed up and written: computed once.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            count = batch.count()
            if count == 0:
                log.info("epoch %s: empty", epoch_id)
                return
            log.info("epoch %s: %s rows", epoch_id, count)
            place = None
            if config and config.snapshot_path:
                place = prepare_snapshot(
                    batch,
                    config.snapshot_path,
                    epoch_id,
                    config.snapshot_ttl_seconds,
                    config.snapshot_rows,
                )
            # Files by size of the batch, not by number of state partitions.
            files = -(-count // ROWS_PER_FILE)
            spark = batch.sparkSession
            query_id = streaming_query_id(spark)
            write_epoch(batch.coalesce(files), path, query_id, epoch_id, unique, place)
            if place:
                # Of an epoch that was listed already, the one named with it.
                publish_snapshot(spark, config.snapshot_path, manifest(spark, path)[1]["snapshot"])
        finally:
            batch.unpersist()

    writer = (
        rows.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    trigger = config.trigger if config else AVAILABLE_NOW
    return writer.trigger(**trigger) if trigger else writer


def _first_run(spark: SparkSession, config: PipelineConfig, name: str, wanted: int) -> int:
    """What the checkpoint's first run had under this name; ``wanted`` if this is it."""
    path = f"{config.checkpoint_path.rstrip('/')}/joined-{name}"
    found = storage.read_text(spark, path)
    if found is None:
        storage.write_text(spark, path, str(wanted))
    return int(found or wanted)


def _fix_layout(spark: SparkSession, config: PipelineConfig) -> PipelineConfig:
    """The salts and the tick of the checkpoint's first run; other salts are refused."""
    begun = storage.exists(spark, f"{config.checkpoint_path.rstrip('/')}/joined-salts")
    salts = _first_run(spark, config, "salts", config.salts or default_salts(spark))
    if config.salts and salts != config.salts:
        raise ValueError(f"this checkpoint was begun with {salts} salts, not {config.salts}")
    # Checkpoints from before there was a tick have all widths.
    tick = _first_run(spark, config, "tick", 1 if begun else config.tick_micros)
    if config.match == "nearest":
        layout = _first_run(spark, config, "layout", 1 if begun else SLOT_LAYOUT)
        if layout != SLOT_LAYOUT:
            raise ValueError(f"this checkpoint holds slots of layout {layout}, not {SLOT_LAYOUT}")
    return replace(config, salts=salts, tick_micros=tick)


def start_joined(
    spark: SparkSession, topics: KafkaTopics | FolderTopics, config: PipelineConfig
) -> StreamingQuery:
    config = _fix_layout(spark, config)
    return table_writer(
        joined_stream(spark, topics, config),
        config.joined_path,
        config.checkpoint("joined"),
        config,
        INCIDENT_KEY,
    ).start()


def start_observations(
    spark: SparkSession, topics: KafkaTopics | FolderTopics, config: PipelineConfig
) -> StreamingQuery:
    return table_writer(
        observations_stream(spark, topics, config),
        config.observations_path,
        config.checkpoint("observations"),
        replace(config, snapshot_path=None),
        OBSERVATION_KEY,
    ).start()


def run(
    spark: SparkSession, topics: KafkaTopics | FolderTopics, config: PipelineConfig
) -> None:
    """Start both queries and wait; when one fails, stop the other and raise."""
    spark.streams.resetTerminated()
    queries = [
        start_joined(spark, topics, config),
        start_observations(spark, topics, config),
    ]
    try:
        if "availableNow" in config.trigger or "once" in config.trigger:
            for query in queries:
                query.awaitTermination()
            if config.finish and config.match == "nearest":
                finish(spark, config)
        else:
            spark.streams.awaitAnyTermination()
    finally:
        for query in queries:
            query.stop()


def finish(spark: SparkSession, config: PipelineConfig) -> bool:
    """Answer what the ended ``nearest`` query holds; False if that was done already."""
    checkpoint = config.checkpoint("joined")
    columns = [c for c in JOINED_TABLE.fieldNames() if c not in CONTEXT_COLUMNS]
    rows = drain.tail(
        spark, checkpoint, columns, config.bucket_seconds, config.tolerance_seconds
    )
    rows = rows.select(*JOINED_TABLE.fieldNames())
    return drain.commit_tail(spark, checkpoint, config.joined_path, rows)


def reset_pipeline(spark: SparkSession, config: PipelineConfig) -> None:
    """Remove both tables, the snapshot and both checkpoints."""
    paths = [config.joined_path, config.observations_path, config.checkpoint_path]
    if config.snapshot_path:
        paths.append(config.snapshot_path)
    reset(spark, *paths)
