from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException

from contexture.sources import snapshot, storage, tables
from contexture.streaming import pipeline
from tests.helpers import joined
from tests.test_streaming import config, feed, session  # noqa: F401 - fixtures


def shown(spark, run, table):
    live = snapshot.read_snapshot(spark, run.snapshot_path, table=table)
    assert live.error is None
    return sorted(r.t_id for r in live.recent.collect())


def test_a_failed_table_write_shows_the_old_snapshot(spark, session, feed, config, folder, monkeypatch):  # noqa: F811
    run = config(match="first", snapshot_path=folder("live"), trigger=pipeline.AVAILABLE_NOW)
    feed.weather((0, "Rain"))
    feed.incidents(("A", 10))
    pipeline.run(session, feed.topics, run)
    assert shown(spark, run, None) == shown(spark, run, run.joined_path) == ["A"]
    feed.weather((60, "Snow"))
    feed.incidents(("B", 70))
    write = tables._write

    def fails(rows, base):
        if base == run.joined_path:
            raise OSError("no space")
        return write(rows, base)

    monkeypatch.setattr(tables, "_write", fails)
    with pytest.raises(StreamingQueryException):
        pipeline.run(session, feed.topics, run)
    assert shown(spark, run, None) == shown(spark, run, run.joined_path) == ["A"]
    monkeypatch.setattr(tables, "_write", write)
    pipeline.run(session, feed.topics, run)
    assert shown(spark, run, None) == shown(spark, run, run.joined_path) == ["B"]
    assert tables.read_joined(spark, run.joined_path).count() == 2
    # What the failed attempt prepared is gone with the snapshots that were shown.
    assert len(storage.names(spark, f"{run.snapshot_path}/data")) <= snapshot.KEPT + 1


def test_a_prepared_snapshot_is_not_shown_until_published(spark, folder):
    path, base = folder("live"), folder("joined")
    rows = joined(spark, [("A", 0, "Minor", "Rain", 1)])
    place = snapshot.prepare_snapshot(rows, path, 0)
    assert snapshot.read_snapshot(spark, path).recent.count() == 0
    assert snapshot.read_snapshot(spark, path, table=base).recent.count() == 0
    assert tables.write_epoch(rows, base, "q", 0, snapshot=place)
    assert snapshot.read_snapshot(spark, path, table=base).recent.count() == 1
    assert snapshot.read_snapshot(spark, path).recent.count() == 0
    snapshot.publish_snapshot(spark, path, place)
    snapshot.publish_snapshot(spark, path, place)
    assert snapshot.read_snapshot(spark, path).recent.count() == 1
    # An epoch that is listed already leaves the name as it is.
    other = snapshot.prepare_snapshot(rows, path, 0)
    assert not tables.write_epoch(rows, base, "q", 0, snapshot=other)
    assert tables.manifest(spark, base)[1]["snapshot"] == place
