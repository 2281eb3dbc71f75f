"""Topics of JSON messages: Kafka, or a folder per topic.

Both kinds offer the same four calls. A message is a row with one column,
``value``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from contexture.functions.records import encode

WEATHER_TOPIC = "weather_topic"
INCIDENT_TOPIC = "traffic_topic"

# A batch read takes no such limits.
STREAM_ONLY = ("maxOffsetsPerTrigger", "minOffsetsPerTrigger", "maxTriggerDelay")


@dataclass(frozen=True)
class KafkaTopics:
    """Topics on a broker. Needs the Kafka connector on the class path.

    ``read_options`` go to the reader (``startingOffsets``,
    ``maxOffsetsPerTrigger``, ``minPartitions``), ``client_options`` to both
    sides (``kafka.security.protocol`` and its like).
    """

    servers: str
    read_options: dict[str, str] = field(default_factory=dict)
    client_options: dict[str, str] = field(default_factory=dict)

    def options(self, topic: str) -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": topic,
            **self.client_options,
            **self.read_options,
        }

    def read_stream(self, spark: SparkSession, topic: str) -> DataFrame:
        reader = spark.readStream.format("kafka").options(**self.options(topic))
        return reader.load().select("value")

    def read(self, spark: SparkSession, topic: str) -> DataFrame:
        options = self.options(topic)
        for name in STREAM_ONLY:
            options.pop(name, None)
        reader = spark.read.format("kafka").options(**options)
        return reader.load().select("value")

    def _write_options(self, topic: str) -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": self.servers,
            "topic": topic,
            **self.client_options,
        }

    def write(self, records: DataFrame, topic: str) -> None:
        writer = encode(records).write.format("kafka")
        writer.options(**self._write_options(topic)).save()

    def write_stream(self, records: DataFrame, topic: str) -> DataStreamWriter:
        writer = encode(records).writeStream.format("kafka")
        return writer.options(**self._write_options(topic))


@dataclass(frozen=True)
class FolderTopics:
    """Topics as folders of text files, one message per line.

    With ``nested``, files in folders below count too.
    """

    root: str
    files_per_batch: int | None = None
    nested: bool = False

    def _nesting(self) -> dict[str, str]:
        return {"recursiveFileLookup": "true"} if self.nested else {}

    def path(self, topic: str) -> str:
        return f"{self.root.rstrip('/')}/{topic}"

    def read_stream(self, spark: SparkSession, topic: str) -> DataFrame:
        reader = spark.readStream.options(**self._nesting())
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", str(self.files_per_batch))
        return reader.text(self.path(topic))

    def read(self, spark: SparkSession, topic: str) -> DataFrame:
        return spark.read.options(**self._nesting()).text(self.path(topic))

    def write(self, records: DataFrame, topic: str) -> None:
        encode(records).write.mode("append").text(self.path(topic))

    def write_stream(self, records: DataFrame, topic: str) -> DataStreamWriter:
        writer = encode(records).writeStream.format("text")
        return writer.option("path", self.path(topic))
