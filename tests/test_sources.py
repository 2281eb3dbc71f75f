from __future__ import annotations

import json
import time
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from contexture import schemas
from contexture.session import shared_dir, state_session
from contexture.sources import landing, snapshot, storage, tables
from contexture.sources.topics import FolderTopics, KafkaTopics
from tests.helpers import at, joined, observed, tuples


def test_epoch_written_twice_counts_once(spark, folder):
    base = folder("joined")
    batch = joined(spark, [("A", 0, "Minor", "Rain", 1), ("B", 0, "Minor", "Rain", 1)])
    tables.write_epoch(batch, base, "q1", 0)
    tables.write_epoch(batch, base, "q1", 0)
    tables.write_epoch(joined(spark, [("C", 0, "Minor", "Rain", 1)]), base, "q1", 1)
    assert [r["t_id"] for r in tables.read_joined(spark, base).orderBy("t_id").collect()] == [
        "A",
        "B",
        "C",
    ]


def test_new_query_keeps_old_epochs(spark, folder):
    base = folder("joined")
    tables.write_epoch(joined(spark, [("A", 0, "Minor", "Rain", 1)]), base, "q1", 0)
    tables.write_epoch(joined(spark, [("B", 0, "Minor", "Rain", 1)]), base, "q2", 0)
    assert tables.read_joined(spark, base).count() == 2


def test_a_replay_shows_neither_hole_nor_double(spark, folder):
    base = folder("joined")
    batch = joined(spark, [("A", 0, "Minor", "Rain", 1)])
    assert tables.write_epoch(batch, base, "q", 0)
    held = tables.read_joined(spark, base)
    assert not tables.write_epoch(batch, base, "q", 0)
    assert held.count() == tables.read_joined(spark, base).count() == 1


def test_an_attempt_that_is_not_listed_is_not_read(spark, folder):
    base = folder("joined")
    tables.write_epoch(joined(spark, [("A", 0, "Minor", "Rain", 1)]), base, "q", 0)
    tables._write(joined(spark, [("B", 0, "Minor", "Rain", 1)]), base)
    assert tables.read_joined(spark, base).count() == 1
    assert tables.drop_unlisted(spark, base) == 1
    assert tables.read_joined(spark, base).count() == 1


def test_past_days_are_compacted(spark, folder):
    base, day = folder("joined"), 86_400
    for epoch, second in enumerate([0, 10, day, day + 1, 3 * day]):
        batch = joined(spark, [(f"I{epoch}", second, "Minor", "Rain", 1)])
        tables.write_epoch(batch, base, "q", epoch)
    before = tuples(tables.read_joined(spark, base))
    assert tables.compact(spark, base, schemas.JOINED_TABLE, (at(2 * day)).date())
    assert len(tables.manifest(spark, base)[1]["folders"]) == 2
    assert not tables.write_epoch(joined(spark, [("X", 0, "Minor", "Rain", 1)]), base, "q", 3)
    tables.drop_unlisted(spark, base, keep_manifests=1)
    assert tuples(tables.read_joined(spark, base)) == before
    assert not tables.compact(spark, base, schemas.JOINED_TABLE, date(1999, 1, 1))


def test_a_time_filter_keeps_other_days_from_being_read(spark, folder, check_plan):
    base, day = folder("joined"), 86_400
    for epoch in range(3):
        tables.write_epoch(
            joined(spark, [(f"I{epoch}", epoch * day, "Minor", "Rain", 1)]), base, "q", epoch
        )
    found = tables.read_joined(spark, base, since=at(day), until=at(day + 5))
    assert [r["t_id"] for r in found.collect()] == ["I1"]
    assert "PartitionFilters: [isnotnull(event_day" in check_plan(found)


def test_sql_sees_batches_that_came_later(spark, folder):
    paths = folder("joined"), folder("seen")
    tables.register_views(spark, *paths)
    text = "SELECT count(*) AS n FROM weather_traffic_comb"
    for epoch in range(2):
        batch = joined(spark, [(f"I{epoch}", 0, "Minor", "Rain", 1)])
        tables.write_epoch(batch, paths[0], "q", epoch)
        assert tables.run_sql(spark, text, *paths).first()["n"] == epoch + 1


def test_table_not_yet_written_is_empty(spark, folder):
    df = tables.read_observations(spark, folder("none"))
    assert df.schema == schemas.OBSERVATION_TABLE
    assert df.count() == 0


def test_views_take_sql_text(spark, folder):
    joined_path, seen_path = folder("joined"), folder("seen")
    tables.write_epoch(
        joined(spark, [("A", 0, "Minor", "Rain", 1), ("B", 9, "Minor", "Rain", 1)]),
        joined_path,
        "q",
        0,
    )
    tables.write_epoch(observed(spark, [(0, "Rain", 1)]), seen_path, "q", 0)
    tables.register_views(spark, joined_path, seen_path)
    listing = spark.sql("SELECT * FROM weather_traffic_comb ORDER BY t_start DESC")
    assert [r["t_id"] for r in listing.collect()] == ["B", "A"]
    assert listing.columns == schemas.JOINED_TABLE.fieldNames()
    assert spark.sql("SELECT * FROM WEATHER_DURATION").count() == 1


def test_reset_removes_tables_and_checkpoints(spark, folder):
    paths = [folder("joined"), folder("seen"), folder("checkpoint")]
    for path in paths[:2]:
        tables.write_epoch(observed(spark, [(0, "Rain", 1)]), path, "q", 0)
    tables.reset(spark, *paths)
    assert not any(storage.exists(spark, path) for path in paths)


def test_query_id_needs_a_streaming_query(spark):
    with pytest.raises(RuntimeError):
        tables.streaming_query_id(spark)


BATCH = [
    ("A", 0, "Minor", "Rain", 1),
    ("B", 60, "Minor", "Rain", 1),
    ("C", 120, "Minor", None, 1),
]


def test_snapshot_lives_until_it_lapses(spark, folder):
    path = folder("snapshot")
    snapshot.write_snapshot(joined(spark, BATCH), path, 0, rows=2, now=at(0))
    live = snapshot.read_snapshot(spark, path, now=at(299))
    assert [r["t_id"] for r in live.recent.orderBy("t_start").collect()] == ["B", "C"]
    assert {(r[0], r[1]) for r in live.counts.collect()} == {("Rain", 2), (None, 1)}
    assert live.last_update == at(0).isoformat()
    assert live.error is None
    lapsed = snapshot.read_snapshot(spark, path, now=at(300))
    assert lapsed.recent.count() == 0 and lapsed.counts.count() == 0
    assert lapsed.last_update is None and lapsed.error is None


def test_snapshot_shows_the_newest_epoch_alone(spark, folder):
    path = folder("snapshot")
    for epoch, rows in enumerate([BATCH, BATCH[:1], BATCH[1:2]]):
        snapshot.write_snapshot(joined(spark, rows), path, epoch, now=at(60 * epoch))
        live = snapshot.read_snapshot(spark, path, now=at(60 * epoch + 1))
        assert live.recent.count() == len(rows)
        assert live.last_update == (at(0) + timedelta(seconds=60 * epoch)).isoformat()


def test_missing_snapshot_is_empty(spark, folder):
    live = snapshot.read_snapshot(spark, folder("none"))
    assert live.recent.count() == 0 and live.counts.count() == 0
    assert live.last_update is None and live.error is None


@pytest.mark.parametrize("part", ["last_update", "recent_incidents", "incident_counts"])
def test_unreadable_snapshot_tells_why(spark, folder, part):
    path = Path(folder("snapshot"))
    snapshot.write_snapshot(joined(spark, BATCH), str(path), 0, now=at(0))
    for part in path.glob(f"data/*/{part}/*.parquet"):
        for crc in part.parent.glob(f".{part.name}.crc"):
            crc.unlink()
        part.write_text("not parquet")
    live = snapshot.read_snapshot(spark, str(path), now=at(1))
    assert live.error
    assert live.recent.count() == live.counts.count() == 0 and live.last_update is None


def test_a_slow_write_does_not_use_up_the_time_to_live(spark, folder):
    path = folder("snapshot")

    def slow(batches):
        time.sleep(3)
        yield from batches

    rows = joined(spark, BATCH)
    slowly = rows.coalesce(1).mapInPandas(slow, rows.schema)
    snapshot.write_snapshot(slowly, path, 0, ttl_seconds=30)
    live = snapshot.read_snapshot(spark, path)
    assert live.recent.count() == 3 and live.last_update


def test_a_held_snapshot_lapses_by_itself(spark, folder):
    path = folder("snapshot")
    snapshot.write_snapshot(joined(spark, BATCH), path, 0, ttl_seconds=3600)
    live = snapshot.read_snapshot(spark, path)
    assert live.recent.count() == 3
    snapshot.write_snapshot(joined(spark, BATCH), path, 1, ttl_seconds=0)
    lapsed = snapshot.read_snapshot(spark, path)
    assert lapsed.recent.count() == lapsed.counts.count() == 0


def test_epochs_of_one_parity_leave_the_live_snapshot_alone(spark, folder):
    path = folder("snapshot")
    snapshot.write_snapshot(joined(spark, BATCH), path, 2)
    held = snapshot.read_snapshot(spark, path)
    snapshot.write_snapshot(joined(spark, BATCH[:1]), path, 4)
    assert held.recent.count() == 3
    assert snapshot.read_snapshot(spark, path).recent.count() == 1


def test_folder_topic_keeps_records(spark, folder):
    topics = FolderTopics(folder("topics"))
    rows = [("A", "t", None, "2024-03-01T00:00:40Z", "x")]
    records = spark.createDataFrame(rows, schemas.INCIDENT_RECORD)
    topics.write(records, "traffic_topic")
    topics.write(records, "traffic_topic")
    messages = topics.read(spark, "traffic_topic")
    assert messages.columns == ["value"]
    assert json.loads(messages.first()["value"])["severity"] is None
    assert messages.count() == 2


def test_kafka_options():
    topics = KafkaTopics(
        "broker:9092",
        read_options={"startingOffsets": "earliest"},
        client_options={"kafka.security.protocol": "SSL"},
    )
    assert topics.options("weather_topic") == {
        "kafka.bootstrap.servers": "broker:9092",
        "subscribe": "weather_topic",
        "kafka.security.protocol": "SSL",
        "startingOffsets": "earliest",
    }
    assert topics._write_options("t") == {
        "kafka.bootstrap.servers": "broker:9092",
        "topic": "t",
        "kafka.security.protocol": "SSL",
    }


def test_kafka_needs_its_connector(spark):
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        KafkaTopics("broker:9092").read_stream(spark, "weather_topic")


def test_landing_folder_by_line_and_by_file(spark, folder):
    path = Path(folder("landing"))
    path.mkdir()
    (path / "poll.json").write_text('{"current":\n {"dt": 1}}')
    assert landing.read_payloads(spark, str(path)).count() == 2
    whole = landing.read_payloads(spark, str(path), whole_files=True)
    assert json.loads(whole.first()["value"]) == {"current": {"dt": 1}}
    assert landing.read_payloads(spark, str(path), streaming=True).isStreaming


def test_shared_dir_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, other = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert one.startswith(root) and one != other


def test_state_session_leaves_the_caller_alone(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session = state_session(spark, partitions=3)
    assert session.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_tables_read_back_as_written(spark, folder):
    base = folder("seen")
    rows = observed(spark, [(0, "Rain", 1), (60, None, None)])
    tables.write_epoch(rows, base, "q", 0)
    assert tuples(tables.read_observations(spark, base)) == tuples(rows)
