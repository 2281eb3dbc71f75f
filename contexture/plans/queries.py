"""One named query per operator, each over the whole ``events`` table.

Event times leave as epoch seconds, which read alike in every engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contexture import schemas
from contexture.functions.codes import category_label, severity_label
from contexture.functions.times import bucket_number
from contexture.operators import cells, extras, history, marts, normalize
from contexture.operators.context import context_join
from contexture.operators.dedup import INCIDENT_KEY, distinct_incidents
from contexture.plans import events_roles as roles
from contexture.session import shared_dir, state_session
from contexture.sources import landing, ledger, recent, snapshot, tables
from contexture.sources.topics import INCIDENT_TOPIC, WEATHER_TOPIC, FolderTopics
from contexture.streaming import drain, intake, pipeline, publish, quarantine
from contexture.streaming.join import stream_context_join
from contexture.streaming.progress import Totals

Query = Callable[[SparkSession, str], DataFrame]

SINCE = datetime(2024, 1, 15, tzinfo=timezone.utc)
HISTORY_ROWS = 1000
LISTED_ROWS = 30


def _epochs(df: DataFrame) -> DataFrame:
    """Timestamps as epoch seconds under ``<name>_epoch``."""
    return df.selectExpr(
        *[
            f"unix_seconds({name}) AS {name}_epoch" if kind == "timestamp" else name
            for name, kind in df.dtypes
        ]
    )


# Normalisation


def normalize_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = roles.weather_payloads(roles.events(spark, sf_dir))
    rows = normalize.weather_observations(normalize.weather_records(payloads))
    return _epochs(normalize.with_event_time(rows, "w_timestamp"))


def normalize_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = roles.incident_payloads(roles.events(spark, sf_dir))
    return _epochs(normalize.incidents(normalize.incident_records(payloads)))


def incidents_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = roles.incident_payloads(roles.events(spark, sf_dir))
    rows = normalize.incidents(normalize.incident_records(payloads))
    return _epochs(normalize.started_since(rows, SINCE))


def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = roles.events(spark, sf_dir).select(
        F.expr(roles.CATEGORY).alias("category"),
        F.expr(roles.MAGNITUDE).alias("magnitude"),
    )
    counts = codes.groupBy("category", "magnitude").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "category",
        category_label(F.col("category")).alias("t_type"),
        "magnitude",
        severity_label(F.col("magnitude")).alias("t_severity"),
        "n",
    )


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.events(spark, sf_dir).select(
        "event_id",
        (F.lit(38.0) + F.col("value") / 100).alias("lat"),
        (F.lit(-91.0) + F.col("user_id") / 100).alias("lon"),
    )


def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.bounding_box(_points(spark, sf_dir), 38.25, -90.5, 0.25)


def bounding_box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same box over points stored in the order of their cells."""
    path = shared_dir(spark, "points")
    cells.write_points(_points(spark, sf_dir), path)
    return cells.read_box(spark, path, 38.25, -90.5, 0.25)


def bounding_box_date_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box with points on both sides of the date line."""
    lon = F.lit(179.0) + F.col("user_id") % 200 / 100
    points = roles.events(spark, sf_dir).select(
        "event_id",
        (F.lit(-17.0) + F.col("value") / 100).alias("lat"),
        F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"),
    )
    path = shared_dir(spark, "points")
    cells.write_points(points, path)
    return cells.read_box(spark, path, -16.75, 179.75, 0.5)


def payload_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of both feeds that the schemas do not name, by path and kind."""
    source = roles.events(spark, sf_dir)
    weather = extras.extras(roles.later_weather_payloads(source), schemas.WEATHER_PAYLOAD)
    incidents = extras.extras(roles.later_incident_payloads(source), schemas.INCIDENT_PAYLOAD)
    return (
        extras.counts(weather)
        .withColumn("feed", F.lit("weather"))
        .unionByName(extras.counts(incidents).withColumn("feed", F.lit("incidents")))
    )


def minute_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.events(spark, sf_dir).select(
        bucket_number(F.col("ts").cast("timestamp")).alias("minute"),
        F.expr(roles.OBSERVED).alias("observed"),
    )
    return rows.groupBy("minute").agg(
        F.count_if("observed").alias("observations"),
        F.count_if(~F.col("observed")).alias("incidents"),
    )


# De-duplication and the context join


def incidents_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(distinct_incidents(roles.incidents(roles.events(spark, sf_dir))))


def observations_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(roles.observation_table(roles.events(spark, sf_dir)))


def context_join_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(roles.joined_table(roles.events(spark, sf_dir)))


def context_join_any_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = roles.events(spark, sf_dir)
    joined = context_join(
        roles.incidents(source), roles.observations(source), required=None
    )
    return _epochs(joined)


def context_join_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = roles.events(spark, sf_dir)
    joined = context_join(
        roles.incidents(source), roles.observations(source), bucket_seconds=None
    )
    return _epochs(joined)


def context_join_exact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to the microsecond, within tolerance, buckets worked in slots."""
    source = roles.events(spark, sf_dir)
    joined = context_join(
        roles.incidents(source, roles.EXACT),
        roles.observations(source, roles.EXACT),
        bucket_seconds=None,
        slot_seconds=10,
    )
    return joined.withColumn("t_start", F.unix_micros("t_start"))


# Marts


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.observation_table(roles.events(spark, sf_dir))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.joined_table(roles.events(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = roles.events(spark, sf_dir)
    return roles.observation_table(source), roles.joined_table(source)


def rate_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.rate_by_context(*_tables(spark, sf_dir))


def rate_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.rate_by_bucket(*_tables(spark, sf_dir))


def minutes_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.minutes_by_bucket(_observed(spark, sf_dir))


def incidents_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.incidents_by_bucket(_joined(spark, sf_dir))


def severity_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.severity_by_context(_joined(spark, sf_dir))


def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.severity_pivot(_joined(spark, sf_dir))


def severity_pivot_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities that are on no list: a column for each value that the manifest lists."""
    severity = "IF(visibility < 5000, concat('Low ', t_severity), t_severity)"
    joined = _joined(spark, sf_dir).withColumn("t_severity", F.expr(severity))
    base = shared_dir(spark, "joined")
    tables.write_epoch(joined, base, "batch", 0)
    listed = tables.listed_values(spark, base)
    return marts.severity_pivot(tables.read_joined(spark, base), severities=listed, other=None)


def count_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.count_by_context(_joined(spark, sf_dir))


def count_by_context_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = roles.events(spark, sf_dir)
    joined = context_join(
        roles.incidents(source), roles.observations(source), required=None
    )
    return marts.count_by_context(joined, keep_null=True, name="count")


def batch_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _joined(spark, sf_dir)
    return joined.agg(F.count(F.lit(1)).alias("rows_in_batch"))


# History and listings


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(history.first_per_key(_joined(spark, sf_dir)))


def first_per_key_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(history.history(_joined(spark, sf_dir), HISTORY_ROWS))


def first_incident_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(history.first_per_key(roles.incidents(roles.events(spark, sf_dir))))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(history.latest(_joined(spark, sf_dir), snapshot.RECENT_ROWS))


def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(history.newest_first(_joined(spark, sf_dir)))


# Sinks and sources: written to the shared folder, read back from there


def _written_tables(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    observed, joined = _tables(spark, sf_dir)
    joined_path = shared_dir(spark, "joined")
    observations_path = shared_dir(spark, "observations")
    tables.write_epoch(joined, joined_path, "batch", 0)
    tables.write_epoch(observed, observations_path, "batch", 0)
    return joined_path, observations_path


def sql_over_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register_views(spark, *_written_tables(spark, sf_dir))
    return spark.sql(
        """
        SELECT o.weather_desc, o.instants, coalesce(j.incidents, 0) AS incidents
        FROM (SELECT weather_desc, count(*) AS instants
              FROM weather_duration GROUP BY weather_desc) o
        LEFT JOIN (SELECT weather_desc, count(DISTINCT t_id) AS incidents
                   FROM weather_traffic_comb GROUP BY weather_desc) j
        ON o.weather_desc = j.weather_desc
        """
    )


def _in_two_batches(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over tables whose second batch came after the views were registered."""
    observed, joined = _tables(spark, sf_dir)
    paths = shared_dir(spark, "joined"), shared_dir(spark, "observations")
    tables.write_epoch(observed, paths[1], "batch", 0)
    half = F.pmod(F.xxhash64("t_id"), F.lit(2))
    for part in (0, 1):
        tables.write_epoch(joined.where(half == part), paths[0], "batch", part)
        if part == 0:
            tables.register_views(spark, *paths)
    return tables.run_sql(spark, text, *paths)


def sql_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_two_batches(
        spark,
        sf_dir,
        """
        SELECT t_id, unix_seconds(min(t_start)) AS first_start, count(*) AS starts,
               count(DISTINCT weather_desc) AS conditions
        FROM weather_traffic_comb GROUP BY t_id
        """,
    )


def sql_rate_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_two_batches(
        spark, sf_dir, "SELECT vis_range, incident_rate FROM incident_rate_by_bucket"
    )


def _growing(spark: SparkSession, sf_dir: str) -> Iterator[tuple[str, str]]:
    """Both tables after each of two epochs, and after the second was delivered again."""
    observed, joined = (rows.persist(StorageLevel.MEMORY_AND_DISK) for rows in _tables(spark, sf_dir))
    paths = shared_dir(spark, "joined"), shared_dir(spark, "observations")
    try:
        for epoch in (0, 1, 1):
            for rows, path, time in ((joined, paths[0], "t_start"), (observed, paths[1], "w_timestamp")):
                half = F.col(time) >= F.lit(SINCE) if epoch else F.col(time) < F.lit(SINCE)
                tables.write_epoch(rows.where(half), path, "batch", epoch)
            yield paths
    finally:
        observed.unpersist()
        joined.unpersist()


def rate_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from ledgers that were refreshed after each epoch."""
    return [ledger.rate_by_context(spark, *paths) for paths in _growing(spark, sf_dir)][-1]


def rate_by_bucket_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return [ledger.rate_by_bucket(spark, *paths) for paths in _growing(spark, sf_dir)][-1]


def severity_pivot_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return [ledger.severity_pivot(spark, paths[0]) for paths in _growing(spark, sf_dir)][-1]


def _weekly(spark: SparkSession, joined: DataFrame) -> str:
    """The joined table with a folder for each week."""
    base = shared_dir(spark, "joined")
    week = F.date_trunc("week", "t_start")
    weeks = [row[0] for row in joined.select(week).distinct().orderBy(week).collect()]
    for epoch, begin in enumerate(weeks):
        tables.write_epoch(joined.where(week == begin), base, "batch", epoch)
    return base


def history_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that its limit cuts, from the newest folders."""
    joined = _joined(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        base = _weekly(spark, joined)
    finally:
        joined.unpersist()
    return _epochs(recent.history(spark, base, LISTED_ROWS)[0])


def joined_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the ids of the newest rows, from a table of a folder a week."""
    joined = _joined(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        base = _weekly(spark, joined)
        ids = history.latest(joined, snapshot.RECENT_ROWS).select("t_id")
        ids.write.parquet(f"{base}/wanted")
    finally:
        joined.unpersist()
    return _epochs(tables.read_joined(spark, base, ids=spark.read.parquet(f"{base}/wanted")))


def _written_snapshot(spark: SparkSession, sf_dir: str) -> snapshot.Snapshot:
    path = shared_dir(spark, "snapshot")
    batch = _joined(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        snapshot.write_snapshot(batch, path, epoch_id=0)
    finally:
        batch.unpersist()
    return snapshot.read_snapshot(spark, path)


def live_snapshot_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _written_snapshot(spark, sf_dir).recent
    return _epochs(recent.drop("updated_at", "expires_at"))


def live_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written_snapshot(spark, sf_dir).counts.drop("updated_at", "expires_at")


def _landed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Raw payloads of both feeds, dropped into landing folders."""
    source = roles.events(spark, sf_dir)
    folders = shared_dir(spark, "weather"), shared_dir(spark, "incidents")
    roles.weather_payloads(source).write.text(folders[0])
    roles.incident_payloads(source).write.text(folders[1])
    return folders


def _filled_topics(spark: SparkSession, sf_dir: str) -> FolderTopics:
    """Landed payloads, normalised and published in one go."""
    weather, incidents = _landed(spark, sf_dir)
    topics = FolderTopics(shared_dir(spark, "topics"))
    for folder, to_records, topic in (
        (weather, normalize.weather_records, WEATHER_TOPIC),
        (incidents, normalize.incident_records, INCIDENT_TOPIC),
    ):
        topics.write(to_records(landing.read_payloads(spark, folder)), topic)
    return topics


def topic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = _filled_topics(spark, sf_dir)
    return _epochs(normalize.parse_incidents(topics.read(spark, INCIDENT_TOPIC)))


def topic_roundtrip_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = _filled_topics(spark, sf_dir)
    rows = normalize.parse_weather(topics.read(spark, WEATHER_TOPIC))
    return _epochs(normalize.with_event_time(rows, "w_timestamp"))


def _published(spark: SparkSession, sf_dir: str) -> tuple[FolderTopics, list[dict]]:
    """Landed payloads, published by streams, and what the streams counted."""
    topics = FolderTopics(shared_dir(spark, "topics"))
    session = state_session(spark)
    landed = _landed(spark, sf_dir)
    with Totals(session) as totals:
        publishing = publish.start_publishing(
            session,
            *landed,
            topics,
            shared_dir(spark, "checkpoints"),
            pipeline.AVAILABLE_NOW,
        )
        for query in publishing:
            query.awaitTermination()
        counted = [totals.of(query)["observed"] for query in publishing]
    return topics, counted


def stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both topics as they arrive."""
    topics, _ = _published(spark, sf_dir)
    incidents = _epochs(normalize.parse_incidents(topics.read(spark, INCIDENT_TOPIC)))
    weather = _epochs(normalize.parse_weather(topics.read(spark, WEATHER_TOPIC)))
    return incidents.unionByName(weather, allowMissingColumns=True)


def publish_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads landed and those that could not be read, by feed."""
    _, counted = _published(spark, sf_dir)
    rows = [
        (feed, own[f"{feed}_payloads.rows"], own[f"{feed}_payloads.rejects"])
        for feed, own in zip(("weather", "incidents"), counted, strict=True)
    ]
    return spark.createDataFrame(rows, "feed string, payloads bigint, rejects bigint")


def ingestion_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by feed, and whether their processing time is well formed."""
    source = roles.events(spark, sf_dir)
    form = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}[+-]\d\d:\d\d$"
    parts = [
        records.select(
            F.lit(feed).alias("feed"), F.col("ingestion_time").rlike(form).alias("well_formed")
        )
        for feed, records in (
            ("weather", normalize.weather_records(roles.weather_payloads(source))),
            ("incidents", normalize.incident_records(roles.incident_payloads(source))),
        )
    ]
    rows = parts[0].unionByName(parts[1]).groupBy("feed", "well_formed")
    return rows.agg(F.count(F.lit(1)).alias("records"))


# Streams: run over all available files, then read back from the written table


def _known(rows: DataFrame, delivered: DataFrame, name: str) -> DataFrame:
    """Whether each row's values, in the columns of ``delivered``, were delivered."""
    found = delivered.distinct().withColumn(name, F.lit(True)).alias("d")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in delivered.columns]
    out = rows.alias("r").join(found, same, "left")
    return out.select("r.*", F.coalesce(F.col(f"d.{name}"), F.lit(False)).alias(name))


def _by_minute(observations: DataFrame) -> DataFrame:
    return observations.select(
        F.date_trunc("minute", "w_timestamp").alias("minute"),
        "weather_desc",
        "visibility",
        "rain",
    )


def _checked(joined: DataFrame, incidents: DataFrame, observations: DataFrame) -> DataFrame:
    """Joined rows by key, with what is open told as delivered or not."""
    rows = joined.withColumn("minute", F.date_trunc("minute", "t_start"))
    rows = _known(rows, _by_minute(observations), "context_known")
    rows = _known(rows, incidents, "incident_known")
    return rows.selectExpr(
        "t_id", "unix_seconds(t_start) AS t_start_epoch", "incident_known", "context_known"
    )


def _stream_table(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    base = shared_dir(spark, name)
    writer = pipeline.table_writer(rows, f"{base}/table", f"{base}/checkpoint")
    writer.start().awaitTermination()
    return tables.read_table(spark, f"{base}/table", rows.schema)


def _run_stream(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    return _epochs(_stream_table(spark, rows, name))


def _role_streams(
    spark: SparkSession, sf_dir: str, time: str = roles.SECOND
) -> tuple[DataFrame, DataFrame]:
    source = roles.event_stream(state_session(spark), sf_dir)
    return (
        intake.incident_stream(roles.incidents(source, time)),
        intake.observation_stream(roles.observations(source, time)),
    )


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which copy of a key arrives first is open: it must be one of those delivered.
    rows = intake.distinct_incident_stream(_role_streams(spark, sf_dir)[0])
    table = _stream_table(spark, rows, "stream-incidents")
    delivered = roles.incidents(roles.events(spark, sf_dir))
    return _epochs(_known(table, delivered, "known").drop("t_type", "t_severity"))


def stream_dedup_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake.distinct_observation_stream(_role_streams(spark, sf_dir)[1])
    table = _stream_table(spark, rows, "stream-observations")
    delivered = roles.observations(roles.events(spark, sf_dir)).drop("rain")
    return _epochs(_known(table, delivered, "known").select("w_timestamp", "known"))


def stream_context_join_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents, observations = _role_streams(spark, sf_dir)
    rows = stream_context_join(
        incidents, observations, match="nearest", tick_micros=pipeline.RECORD_TICK
    )
    return _run_stream(spark, rows, "stream-nearest")


def stream_context_join_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents, observations = _role_streams(spark, sf_dir)
    rows = stream_context_join(
        incidents,
        observations,
        match="nearest",
        bucket_seconds=None,
        tick_micros=pipeline.RECORD_TICK,
    )
    return _run_stream(spark, rows, "stream-tolerance")


def stream_drained_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream to its end, and then what it still held, answered twice: all rows once."""
    incidents, observations = _role_streams(spark, sf_dir)
    rows = stream_context_join(
        incidents,
        observations,
        match="nearest",
        bucket_seconds=None,
        tick_micros=pipeline.RECORD_TICK,
    )
    base = shared_dir(spark, "stream-drained")
    table, checkpoint = f"{base}/table", f"{base}/checkpoint"
    pipeline.table_writer(rows, table, checkpoint).start().awaitTermination()
    session = state_session(spark)
    rest = drain.tail(session, checkpoint, incidents.columns, bucket_seconds=None)
    drain.commit_tail(session, checkpoint, table, rest.select(*rows.columns))
    drain.commit_tail(session, checkpoint, table, rest.select(*rows.columns))
    return _epochs(tables.read_table(spark, table, rows.schema))


def stream_replayed_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated incidents, then all of them again under a new checkpoint."""
    base = shared_dir(spark, "stream-replayed")
    for run in (1, 2):
        rows = intake.distinct_incident_stream(_role_streams(spark, sf_dir)[0])
        writer = pipeline.table_writer(
            rows, f"{base}/table", f"{base}/checkpoint-{run}", unique=INCIDENT_KEY
        )
        writer.start().awaitTermination()
    table = tables.read_table(spark, f"{base}/table", rows.schema)
    delivered = roles.incidents(roles.events(spark, sf_dir))
    return _epochs(_known(table, delivered, "known").drop("t_type", "t_severity"))


def stream_context_join_exact_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to the microsecond, within tolerance."""
    incidents, observations = _role_streams(spark, sf_dir, roles.EXACT)
    rows = stream_context_join(
        incidents, observations, match="nearest", bucket_seconds=None
    )
    table = _stream_table(spark, rows, "stream-exact")
    return table.withColumn("t_start", F.unix_micros("t_start"))


def stream_context_join_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which observation of a bucket arrives first is open: it must be one of these.
    incidents, observations = _role_streams(spark, sf_dir)
    rows = stream_context_join(incidents, observations, match="first", required=None)
    source = roles.events(spark, sf_dir)
    table = _stream_table(spark, rows, "stream-first")
    return _checked(table, roles.incidents(source), roles.observations(source))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events delivered again after the watermark has passed most of them."""
    source = roles.events(spark, sf_dir)
    base = shared_dir(spark, "late")
    session = state_session(spark)

    def deliver() -> StreamingQuery:
        source.write.mode("append").parquet(f"{base}/events")
        stream = session.readStream.schema(source.schema).parquet(f"{base}/events")
        rows = intake.distinct_incident_stream(
            intake.incident_stream(roles.incidents(stream))
        )
        query = pipeline.table_writer(rows, f"{base}/table", f"{base}/checkpoint").start()
        query.awaitTermination()
        return query

    deliver()
    with Totals(session) as totals:
        late = totals.of(deliver())["late"]
    return spark.createDataFrame([(late,)], "late_rows bigint")


def _gated(spark: SparkSession, sf_dir: str) -> tuple[str, FolderTopics, FolderTopics, int]:
    """Incident messages through a gate and a stateful query, newer events delivered first.

    Base folder, all topics and those behind the gate, and the rows that the stateful
    query dropped as late.
    """
    source = roles.events(spark, sf_dir)
    base = shared_dir(spark, "gated")
    session = state_session(spark)
    topics, passed = FolderTopics(f"{base}/in"), FolderTopics(f"{base}/out", nested=True)
    newer = F.col("event_id") > F.lit(source.agg(F.expr("max(event_id) DIV 2")).first()[0])
    late = 0
    for part in (source.where(newer), source.where(~newer)):
        payloads = roles.incident_payloads(part)
        topics.write(normalize.incident_records(payloads), INCIDENT_TOPIC)
        payloads.where("value = 'junk'").write.mode("append").text(topics.path(INCIDENT_TOPIC))
        quarantine.start_gate(
            session, topics, INCIDENT_TOPIC, passed, f"{base}/kept", f"{base}/gate",
            trigger=pipeline.AVAILABLE_NOW,
        ).awaitTermination()
        rows = intake.incidents_from_topic(passed.read_stream(session, INCIDENT_TOPIC))
        rows = intake.distinct_incident_stream(rows)
        with Totals(session) as totals:
            query = pipeline.table_writer(
                rows, f"{base}/table", f"{base}/checkpoint", unique=INCIDENT_KEY
            ).start()
            query.awaitTermination()
            late += totals.of(query)["late"]
    return base, topics, passed, late


def late_rows_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplicated incidents of a stream that met half of them late, and these played again."""
    base, topics, _, _ = _gated(spark, sf_dir)
    for _ in (1, 2):
        quarantine.replay(
            spark, f"{base}/kept", f"{base}/table", normalize.parse_incidents, INCIDENT_KEY
        )
    delivered = normalize.parse_incidents(topics.read(spark, INCIDENT_TOPIC))
    table = tables.read_table(spark, f"{base}/table", delivered.schema)
    return _epochs(_known(table, delivered, "known").drop("t_type", "t_severity"))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages kept back by reason, those passed on, and those a stateful query then dropped."""
    base, _, passed, late = _gated(spark, sf_dir)
    kept = quarantine.read_quarantine(spark, f"{base}/kept")
    kept = kept.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    messages = passed.read(spark, INCIDENT_TOPIC)
    return kept.unionByName(
        messages.agg(F.lit("passed").alias("reason"), F.count(F.lit(1)).alias("n"))
    ).unionByName(spark.createDataFrame([("late behind the gate", late)], "reason string, n bigint"))


def pipeline_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of incidents, then one without any: the latter adds no epoch."""
    source = roles.events(spark, sf_dir)
    base = shared_dir(spark, "epochs")
    session = state_session(spark)
    batches = 0
    with Totals(session) as totals:
        for part in (roles.INCIDENT, roles.OBSERVED):
            source.where(part).write.mode("append").parquet(f"{base}/events")
            stream = session.readStream.schema(source.schema).parquet(f"{base}/events")
            rows = intake.incident_stream(roles.incidents(stream))
            writer = pipeline.table_writer(rows, f"{base}/table", f"{base}/checkpoint")
            query = writer.start()
            query.awaitTermination()
            batches += totals.of(query)["batches"] > 0
    listed = tables.manifest(spark, f"{base}/table")[1]["folders"]
    table = tables.read_table(spark, f"{base}/table", rows.schema)
    return table.agg(
        F.lit(batches).cast("bigint").alias("runs"),
        F.lit(len(listed)).cast("bigint").alias("epochs"),
        F.count(F.lit(1)).alias("rows"),
    )


def _run_pipeline(
    spark: SparkSession, topics: FolderTopics, match: str
) -> tuple[DataFrame, DataFrame, snapshot.Snapshot]:
    """Both tables and the snapshot after all topics have been worked off."""
    base = shared_dir(spark, "pipeline")
    config = pipeline.PipelineConfig(
        joined_path=f"{base}/joined",
        observations_path=f"{base}/observations",
        checkpoint_path=f"{base}/checkpoints",
        snapshot_path=f"{base}/snapshot",
        match=match,
        trigger=pipeline.AVAILABLE_NOW,
    )
    pipeline.run(state_session(spark), topics, config)
    return (
        tables.read_joined(spark, config.joined_path),
        tables.read_observations(spark, config.observations_path),
        snapshot.read_snapshot(spark, config.snapshot_path, table=config.joined_path),
    )


def _part(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("part", F.lit(name))


def pipeline_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing folders to topics to both tables and the snapshot: all rows."""
    topics = _filled_topics(spark, sf_dir)
    joined, observed, live = _run_pipeline(spark, topics, "nearest")
    delivered = normalize.parse_weather(topics.read(spark, WEATHER_TOPIC)).drop("rain")
    seen = _known(observed, delivered, "known").select("w_timestamp", "known")
    counts = live.counts.select("weather_desc", "count")
    return (
        _part(_epochs(joined), "joined")
        .unionByName(_part(_epochs(seen), "observations"), allowMissingColumns=True)
        .unionByName(_part(counts, "snapshot"), allowMissingColumns=True)
    )


def pipeline_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode, content checked where the pick is open.

    An incident's row depends on which observation came first where its minute has
    labelled and unlabelled ones. Rows of other minutes are listed; of these
    minutes', and of the snapshot, those are counted that were never delivered.
    """
    topics = _filled_topics(spark, sf_dir)
    joined, observed, live = _run_pipeline(spark, topics, "first")
    incidents = normalize.parse_incidents(topics.read(spark, INCIDENT_TOPIC))
    weather = normalize.with_event_time(
        normalize.parse_weather(topics.read(spark, WEATHER_TOPIC)), "w_timestamp"
    )
    rows = _checked(joined, incidents, weather)
    open_ = (
        _by_minute(weather)
        .groupBy(F.unix_seconds("minute").alias("minute"))
        .agg(F.count_if(F.expr("weather_desc IS NULL")).alias("unlabelled"))
        .where("unlabelled > 0")
    )
    rows = rows.withColumn("minute", F.expr("t_start_epoch - pmod(t_start_epoch, 60)"))
    sure = rows.join(open_, "minute", "left_anti").drop("minute")
    wrong = rows.agg(F.count_if(F.expr("NOT (incident_known AND context_known)")).alias("wrong"))
    recent = live.recent.drop("updated_at", "expires_at")
    strange = recent.exceptAll(joined).agg(F.count(F.lit(1)).alias("wrong"))
    seen = _known(observed, weather.drop("rain"), "context_known")
    seen = seen.select("w_timestamp", "context_known")
    return (
        _part(sure, "joined")
        .unionByName(_part(_epochs(seen), "observations"), allowMissingColumns=True)
        .unionByName(_part(wrong, "joined_not_delivered"), allowMissingColumns=True)
        .unionByName(_part(strange, "snapshot_not_joined"), allowMissingColumns=True)
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        rate_by_context,
        normalize_weather,
        normalize_incidents,
        incidents_since,
        code_labels,
        bounding_box,
        bounding_box_cells,
        bounding_box_date_line,
        payload_extras,
        minute_bucket,
        incidents_dedup,
        observations_dedup,
        context_join_nearest,
        context_join_any_label,
        context_join_tolerance,
        context_join_exact_times,
        rate_by_bucket,
        minutes_by_bucket,
        incidents_by_bucket,
        severity_by_context,
        severity_pivot,
        severity_pivot_open,
        count_by_context,
        count_by_context_with_null,
        batch_row_count,
        first_per_key,
        first_per_key_history,
        first_incident_per_key,
        latest_snapshot,
        newest_first,
        sql_over_tables,
        sql_history,
        sql_rate_by_bucket,
        rate_incremental,
        rate_by_bucket_incremental,
        severity_pivot_incremental,
        history_limited,
        joined_by_ids,
        live_snapshot_recent,
        live_snapshot_counts,
        topic_roundtrip,
        topic_roundtrip_weather,
        stream_publish,
        publish_rejects,
        ingestion_stamp,
        stream_dedup,
        stream_dedup_observations,
        stream_context_join_nearest,
        stream_context_join_tolerance,
        stream_drained_tolerance,
        stream_replayed_from_zero,
        stream_context_join_exact_times,
        stream_context_join_first,
        stream_late_rows,
        late_rows_replayed,
        quarantined,
        pipeline_epochs,
        pipeline_tables,
        pipeline_first,
    )
}
