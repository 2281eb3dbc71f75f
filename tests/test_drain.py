from __future__ import annotations

import pytest

from contexture.operators.context import context_join
from contexture.operators.normalize import parse_incidents, parse_weather
from contexture.sources import tables
from contexture.sources.topics import INCIDENT_TOPIC, WEATHER_TOPIC
from contexture.streaming import drain, pipeline
from tests.test_streaming import (  # noqa: F401 - fixtures
    config,
    feed,
    joined_rows,
    session,
)


def batch_rows(spark, feed, **settings):
    rows = context_join(
        parse_incidents(feed.topics.read(spark, INCIDENT_TOPIC)),
        parse_weather(feed.topics.read(spark, WEATHER_TOPIC)),
        **settings,
    )
    return sorted((r.t_id, int(r.t_start.timestamp())) for r in rows.collect())


def stored(spark, run):
    rows = tables.read_joined(spark, run.joined_path).collect()
    return sorted((r.t_id, int(r.t_start.timestamp())) for r in rows)


@pytest.mark.parametrize("bucket", [60, None])
def test_a_finished_run_has_all_rows(spark, session, feed, config, bucket):  # noqa: F811
    feed.weather((0, "Rain"), (30, "Snow"), (700, "Clear"), (1500, None), (1530, "Mist"))
    feed.incidents(("A", 10), ("A", 10), ("B", 40), ("C", 705), ("D", 1510), ("E", 1525))
    run = config(match="nearest", bucket_seconds=bucket, trigger=pipeline.AVAILABLE_NOW)
    pipeline.run(session, feed.topics, run)
    whole = batch_rows(spark, feed, bucket_seconds=bucket)
    assert set(stored(spark, run)) < set(whole)
    assert pipeline.finish(session, run)
    assert stored(spark, run) == whole
    assert not pipeline.finish(session, run)


def test_a_restart_after_the_tail_repeats_no_row(spark, session, feed, config):  # noqa: F811
    feed.weather((0, "Rain"), (700, "Clear"))
    feed.incidents(("A", 10), ("B", 710))
    run = config(match="nearest", finish=True, trigger=pipeline.AVAILABLE_NOW)
    pipeline.run(session, feed.topics, run)
    assert joined_rows(spark, run) == [("A", 10, "Rain"), ("B", 710, "Clear")]
    # B's minute is passed now, so the stream answers it again; C is new to it.
    feed.weather((708, "Snow"), (2000, "Mist"), (4000, "Rain"))
    feed.incidents(("C", 712), ("D", 2001), ("E", 4001))
    pipeline.run(session, feed.topics, run)
    assert joined_rows(spark, run) == [
        ("A", 10, "Rain"),
        ("B", 710, "Clear"),
        ("C", 712, "Snow"),
        ("D", 2001, "Mist"),
        ("E", 4001, "Rain"),
    ]


def test_an_empty_tail(spark, session, feed, config):  # noqa: F811
    feed.weather((0, "Rain"), (4000, "Clear"))
    feed.incidents(("A", 10), ("Z", 4100))
    run = config(match="nearest", finish=True, trigger=pipeline.AVAILABLE_NOW)
    pipeline.run(session, feed.topics, run)
    assert joined_rows(spark, run) == [("A", 10, "Rain")]


def test_a_checkpoint_of_another_stream_is_refused(spark, session, feed, config):  # noqa: F811
    feed.weather((0, "Rain"))
    feed.incidents(("A", 10))
    run = config(match="first", trigger=pipeline.AVAILABLE_NOW)
    pipeline.run(session, feed.topics, run)
    with pytest.raises(ValueError):
        drain.held_incidents(session, run.checkpoint("joined"), ["t_type", "t_severity"])
    with pytest.raises(FileNotFoundError):
        drain.query_id(session, run.joined_path)


def test_a_lost_checkpoint_adds_nothing_twice(spark, session, feed, config):  # noqa: F811
    feed.weather((0, "Rain"), (60, "Snow"), (3000, "Clear"))
    feed.incidents(("A", 10), ("B", 70), ("C", 3010))
    run = config(match="nearest", finish=True, trigger=pipeline.AVAILABLE_NOW)
    pipeline.run(session, feed.topics, run)
    before = joined_rows(spark, run)
    seen = tables.read_observations(spark, run.observations_path).count()
    again = config(
        match="nearest",
        finish=True,
        trigger=pipeline.AVAILABLE_NOW,
        joined_path=run.joined_path,
        observations_path=run.observations_path,
    )
    feed.incidents(("D", 75))
    pipeline.run(session, feed.topics, again)
    assert joined_rows(spark, again) == sorted([*before, ("D", 75, "Snow")])
    assert tables.read_observations(spark, run.observations_path).count() == seen


def test_the_tail_has_ends_of_buckets_already_passed(spark, session, feed, config):  # noqa: F811
    # The watermark stands at 700: A's window is open, that of Rain's own bucket closed.
    feed.weather((200, "Snow"), (290, "Rain"), (1300, "Clear"))
    feed.incidents(("A", 310), ("Z", 1300))
    run = config(
        match="nearest", bucket_seconds=None, finish=True, trigger=pipeline.AVAILABLE_NOW
    )
    pipeline.run(session, feed.topics, run)
    assert joined_rows(spark, run) == [("A", 310, "Rain"), ("Z", 1300, "Clear")]
