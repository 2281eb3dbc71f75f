from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from contexture.functions.times import WIDE_PATTERNS
from contexture.operators import normalize
from contexture.operators.dedup import INCIDENT_KEY
from contexture.sources import storage, tables
from contexture.sources.topics import INCIDENT_TOPIC, WEATHER_TOPIC, FolderTopics
from contexture.streaming import intake, pipeline, quarantine
from contexture.streaming.progress import Totals
from tests.helpers import at

NOW = pipeline.AVAILABLE_NOW


def message(name, seconds, start=None):
    start = start or at(seconds).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"id": name, "type": "Accident", "severity": "Minor", "start_time": start})


class Gate:
    def __init__(self, spark, base):
        self.spark, self.base = spark, base
        self.topics = FolderTopics(f"{base}/in")
        self.passed = FolderTopics(f"{base}/out", nested=True)

    def deliver(self, *values):
        df = self.spark.createDataFrame([(v,) for v in values], "value string")
        df.write.mode("append").text(self.topics.path(INCIDENT_TOPIC))
        return self.run()

    def run(self):
        query = quarantine.start_gate(
            self.spark, self.topics, INCIDENT_TOPIC, self.passed,
            f"{self.base}/kept", f"{self.base}/gate", trigger=NOW,
        )
        query.awaitTermination()

    def through(self):
        rows = self.passed.read(self.spark, INCIDENT_TOPIC).collect()
        return sorted(json.loads(r.value)["id"] for r in rows)

    def kept(self):
        rows = quarantine.read_quarantine(self.spark, f"{self.base}/kept").collect()
        return sorted((r.reason, r.value, r.epoch) for r in rows)

    def table(self):
        """What a stateful query behind the gate has, and how many rows it dropped."""
        rows = intake.incidents_from_topic(self.passed.read_stream(self.spark, INCIDENT_TOPIC))
        rows = intake.distinct_incident_stream(rows)
        with Totals(self.spark) as totals:
            query = pipeline.table_writer(
                rows, f"{self.base}/table", f"{self.base}/ckpt", unique=INCIDENT_KEY
            ).start()
            query.awaitTermination()
            late = totals.of(query)["late"]
        self.schema = rows.schema
        return self.ids(), late

    def ids(self):
        rows = tables.read_table(self.spark, f"{self.base}/table", self.schema).collect()
        return sorted(r.t_id for r in rows)

    def replay(self, answer=normalize.parse_incidents, **more):
        return quarantine.replay(
            self.spark, f"{self.base}/kept", f"{self.base}/table", answer, INCIDENT_KEY, **more
        )


@pytest.fixture
def gate(spark, folder):
    return Gate(spark, folder("gate"))


def test_messages_are_passed_or_kept_with_the_reason(gate):
    gate.deliver(message("a", 0), message("b", 5000), "junk", message("bad", 0, "soon"), "{}")
    late, edge, good = message("late", 4399), message("edge", 4400), message("good", 4401)
    gate.deliver(late, edge, good)
    assert gate.through() == ["a", "b", "good"]
    assert [(r, e) for r, _, e in gate.kept()] == [
        ("late", 1), ("late", 1), ("unreadable", 0), ("without_time", 0), ("without_time", 0),
    ]
    assert {v for r, v, _ in gate.kept() if r == "late"} == {late, edge}


def test_the_watermark_does_not_go_back(gate):
    gate.deliver(message("a", 5000))
    gate.deliver(message("b", 4500))
    gate.deliver(message("c", 4300))
    assert gate.through() == ["a", "b"]


def test_nothing_is_late_behind_the_gate_and_replay_completes_the_table(gate):
    gate.deliver(message("a", 9000), message("a", 9000))
    assert gate.table() == (["a"], 0)
    gate.deliver(message("b", 100), message("b", 100), message("c", 8500))
    assert gate.table() == (["a", "c"], 0)
    assert gate.replay()
    assert gate.ids() == ["a", "b", "c"]
    assert not gate.replay()
    gate.deliver(message("b", 100), message("d", 200), message("a", 9000))
    assert gate.table() == (["a", "b", "c"], 0)
    assert gate.replay()
    assert gate.ids() == ["a", "b", "c", "d"]


def test_messages_come_back_by_other_patterns(gate):
    gate.deliver(message("a", 0), message("wide", 0, "2024-03-01T02:00:00+02:00"))
    assert gate.table() == (["a"], 0)

    def wide(rows):
        return normalize.parse_incidents(rows, patterns=WIDE_PATTERNS)

    assert gate.replay(wide, reasons=[quarantine.WITHOUT_TIME])
    assert gate.ids() == ["a", "wide"]


def test_an_epoch_run_again_parts_alike(gate, spark, monkeypatch):
    gate.deliver(message("a", 5000))
    write = storage.write_text

    def fail(session, path, text):
        if "/marks/" in path:
            raise OSError("lost")
        return write(session, path, text)

    monkeypatch.setattr(storage, "write_text", fail)
    with pytest.raises(Exception, match="lost"):
        gate.deliver(message("late", 0), message("b", 6000))
    monkeypatch.undo()
    gate.run()
    assert gate.through() == ["a", "b"]
    assert [r for r, _, _ in gate.kept()] == ["late"]


def test_weather_messages_and_unknown_topics(spark):
    rows = spark.createDataFrame([('{"timestamp": 100}',), ('{"timestamp": "x"}',)], "value string")
    found = quarantine.parted(rows, quarantine.event_time(WEATHER_TOPIC), 100_000)
    assert [r.reason for r in found.collect()] == ["late", "without_time"]
    with pytest.raises(ValueError, match="not known"):
        quarantine.event_time("other")


def test_values_as_bytes_and_nulls(spark):
    rows = spark.createDataFrame([(message("a", 0),), (None,), ("",)], "value string")
    rows = rows.select(F.col("value").cast("binary").alias("value"))
    found = quarantine.parted(rows, quarantine.event_time(INCIDENT_TOPIC), None).collect()
    assert [r.reason for r in found] == [None, "unreadable", "unreadable"]


def test_passed_topics_must_be_nested(spark, folder):
    topics = FolderTopics(folder("flat"))
    with pytest.raises(ValueError, match="nested"):
        quarantine.start_gate(spark, topics, INCIDENT_TOPIC, topics, folder("k"), folder("c"))
