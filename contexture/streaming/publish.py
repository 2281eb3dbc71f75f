"""Landing folders to topics: raw payloads in, records out, as two queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from contexture.operators.normalize import (
    incident_records,
    readable,
    weather_records,
)
from contexture.sources.landing import read_payloads
from contexture.sources.topics import (
    INCIDENT_TOPIC,
    WEATHER_TOPIC,
    FolderTopics,
    KafkaTopics,
)


def start_publishing(
    spark: SparkSession,
    weather_folder: str,
    incident_folder: str,
    topics: KafkaTopics | FolderTopics,
    checkpoint_path: str,
    trigger: dict | None = None,
    whole_files: bool = False,
) -> list[StreamingQuery]:
    """Publish every readable payload that lands, each folder to its topic.

    Each query reports ``rows`` and ``rejects`` as observed metrics.
    """
    queries = []
    for feed, folder, to_records, topic in (
        ("weather", weather_folder, weather_records, WEATHER_TOPIC),
        ("incidents", incident_folder, incident_records, INCIDENT_TOPIC),
    ):
        payloads = read_payloads(spark, folder, streaming=True, whole_files=whole_files)
        records = to_records(readable(payloads, feed))
        writer = topics.write_stream(records, topic).option(
            "checkpointLocation", f"{checkpoint_path.rstrip('/')}/{topic}"
        )
        writer = writer.trigger(**trigger) if trigger else writer
        queries.append(writer.start())
    return queries
