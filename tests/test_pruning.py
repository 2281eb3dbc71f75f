from __future__ import annotations

import random

import pytest

from contexture.sources import pruning, tables
from tests.helpers import at, joined, observed

HOUR = 3600


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "t_id string")


@pytest.fixture
def table(spark, folder):
    """Ten folders of an hour each, thirty ids in each, one id in all of them."""
    base = folder("joined")
    for k in range(10):
        rows = [(f"I{k}-{n}", k * HOUR + n, "Minor", "Rain", n) for n in range(30)]
        rows += [("everywhere", k * HOUR, "Minor", "Snow", k)]
        tables.write_epoch(joined(spark, rows), base, "q", k)
    return base


def test_folders_of_other_times_are_not_listed(spark, table):
    found = tables.folders(spark, table, at(3 * HOUR + 29), at(5 * HOUR))
    assert [e["epoch"] for e in found] == [3, 4, 5]
    rows = tables.read_joined(spark, table, since=at(3 * HOUR + 29), until=at(5 * HOUR))
    assert {f.split("/attempt=")[1][:32] for f in rows.inputFiles()} == {
        e["folder"].partition("=")[2] for e in found
    }
    assert rows.count() == 1 + 31 + 2
    assert tables.folders(spark, table, at(-10), at(-1)) == []
    assert tables.read_joined(spark, table, until=at(-1)).count() == 0


def test_folders_without_an_id_are_left_out_and_none_wrongly(spark, table):
    pick = random.Random(1)
    left_out = 0
    for _ in range(6):
        wanted = {f"I{pick.randrange(12)}-{pick.randrange(40)}" for _ in range(2)}
        found = tables.folders(spark, table, ids=ids(spark, *wanted))
        left_out += 10 - len(found)
        rows = tables.read_joined(spark, table, ids=ids(spark, *wanted, *wanted))
        expected = sorted(w for w in wanted if int(w[1:].split("-")[0]) < 10 and int(w.split("-")[1]) < 30)
        assert sorted(r.t_id for r in rows.collect()) == expected
    assert left_out >= 40
    assert len(tables.folders(spark, table, ids=ids(spark, "everywhere"))) == 10
    rows = tables.read_joined(spark, table, ids=ids(spark, "everywhere"), since=at(8 * HOUR))
    assert rows.count() == 2


def test_many_pages_and_null_ids(spark, folder):
    base = folder("joined")
    rows = [(f"I{n}", n, "Minor", "Rain", n) for n in range(20_000)] + [(None, 5, "Minor", "Rain", 0)]
    tables.write_epoch(joined(spark, rows), base, "q", 0)
    entry = tables.manifest(spark, base)[1]["folders"][0]
    assert entry["filter"]["pages"] == 8 and entry["rows"] == 20_001
    every = spark.createDataFrame(rows, "t_id string, n long, a string, b string, c long").select("t_id")
    assert tables.read_joined(spark, base, ids=every).count() == 20_000
    strangers = [
        bool(tables.folders(spark, base, ids=ids(spark, f"X{n}"))) for n in range(12)
    ]
    assert sum(strangers) <= 2
    assert tables.read_joined(spark, base, ids=ids(spark, None)).count() == 0


def test_folders_without_span_or_filter_are_always_read(spark, table):
    number, content = tables.manifest(spark, table)
    for entry in content["folders"]:
        entry.pop("span")
        entry.pop("filter")
    tables._commit(spark, table, number + 1, content)
    assert len(tables.folders(spark, table, at(0), at(1), ids(spark, "nobody"))) == 10
    assert tables.read_joined(spark, table, ids=ids(spark, "I3-4")).count() == 1


def test_compacted_folders_have_span_and_filter(spark, folder):
    base, day = folder("joined"), 24 * HOUR
    for k in range(4):
        tables.write_epoch(joined(spark, [(f"I{k}", k * day, "Minor", "Rain", 1)]), base, "q", k)
    assert tables.compact(spark, base, tables.JOINED_TABLE, at(3 * day).date())
    merged, last = tables.manifest(spark, base)[1]["folders"]
    assert merged["span"][1] - merged["span"][0] == 2 * day * 1_000_000
    assert [e["folder"] for e in tables.folders(spark, base, ids=ids(spark, "I3"))] == [last["folder"]]
    assert tables.read_joined(spark, base, ids=ids(spark, "I1")).count() == 1


def test_rows_of_another_query_are_known_by_content(spark, folder):
    base, key = folder("joined"), ["t_id", "t_start"]
    first = [("A", 0, "Minor", "Rain", 1), (None, 5, "Minor", "Rain", 1)]
    assert tables.write_epoch(joined(spark, first), base, "q1", 0, key)
    more = [*first, ("A", 1, "Minor", "Rain", 1), ("B", 0, "Minor", "Rain", 1)]
    assert tables.write_epoch(joined(spark, more), base, "q2", 0, key)
    assert tables.read_joined(spark, base).count() == 4
    assert tables.write_epoch(joined(spark, more), base, "q3", 0, key)
    content = tables.manifest(spark, base)[1]
    assert len(content["folders"]) == 2 and content["done"] == {"q1": 0, "q2": 0, "q3": 0}
    # Without the columns, and within one query, rows are taken as they are.
    assert tables.write_epoch(joined(spark, first), base, "q4", 0)
    assert tables.write_epoch(joined(spark, first), base, "q1", 1, key)
    assert tables.read_joined(spark, base).count() == 6


def test_a_writer_that_was_overtaken_asks_again(spark, folder, monkeypatch):
    base, key = folder("joined"), ["t_id", "t_start"]
    rows = joined(spark, [("A", 0, "Minor", "Rain", 1)])
    commit, calls = tables._commit, []

    def overtaken(spark_, base_, number, content):
        calls.append(number)
        if len(calls) == 1:
            assert tables.write_epoch(rows, base, "other", 0, key)
            return False
        return commit(spark_, base_, number, content)

    monkeypatch.setattr(tables, "_commit", overtaken)
    assert tables.write_epoch(rows, base, "mine", 0, key)
    assert tables.read_joined(spark, base).count() == 1


def test_observations_are_known_by_their_instant(spark, folder):
    base = folder("observed")
    tables.write_epoch(observed(spark, [(0, "Rain", 1), (60, "Snow", 2)]), base, "q1", 0, ["w_timestamp"])
    tables.write_epoch(observed(spark, [(60, "Mist", 3), (120, None, None)]), base, "q2", 0, ["w_timestamp"])
    rows = tables.read_observations(spark, base).orderBy("w_timestamp").collect()
    assert [r.weather_desc for r in rows] == ["Rain", "Snow", None]


def test_an_empty_batch_has_no_folder(spark, folder):
    base = folder("joined")
    assert tables.write_epoch(joined(spark, []), base, "q", 0, ["t_id", "t_start"])
    assert tables.manifest(spark, base)[1] == {"folders": [], "done": {"q": 0}}
    assert pruning.within([], 0, 1) == []
