from __future__ import annotations

import random

import pytest

from contexture.operators import history, marts
from contexture.sources import ledger, recent, storage, tables
from tests.helpers import at, joined, observed, tuples

LABELS = ["Rain", "Snow", None, "Clear"]
SEVERITIES = ["Minor", "Major", "Odd one", None]


def some_joined(spark, seed, day=0, count=60):
    pick = random.Random(seed)
    rows = [
        (
            pick.choice(["A", "B", "C", "D", "E", None]) or None,
            day * 86_400 + pick.randrange(5000),
            pick.choice(SEVERITIES),
            pick.choice(LABELS),
            pick.choice([None, 0, 1999, 2000, 6000, 20_000]),
        )
        for _ in range(count)
    ]
    return joined(spark, rows)


def some_observed(spark, seed, count=60):
    pick = random.Random(seed)
    rows = [(pick.randrange(300), pick.choice([*LABELS, "Mist"]), pick.choice([None, 10, 7000])) for _ in range(count)]
    return observed(spark, rows)


@pytest.fixture
def paths(folder):
    return folder("joined"), folder("observed")


def same(spark, paths):
    rows, seen = tables.read_joined(spark, paths[0]), tables.read_observations(spark, paths[1])
    assert tuples(ledger.rate_by_context(spark, *paths)) == tuples(marts.rate_by_context(seen, rows))
    assert tuples(ledger.rate_by_bucket(spark, *paths)) == tuples(marts.rate_by_bucket(seen, rows))
    assert tuples(ledger.severity_by_context(spark, paths[0])) == tuples(marts.severity_by_context(rows))
    pivot = ledger.severity_pivot(spark, paths[0])
    assert pivot.columns[1:] == sorted({r[0] for r in rows.select("t_severity").distinct().collect()} - {None})
    assert tuples(pivot) == tuples(marts.severity_pivot(rows, severities=pivot.columns[1:], other=None))


def test_marts_from_ledgers_are_those_of_the_tables(spark, paths):
    for epoch in range(3):
        tables.write_epoch(some_joined(spark, epoch), paths[0], "q", epoch)
        tables.write_epoch(some_observed(spark, 10 + epoch), paths[1], "q", epoch)
        tables.write_epoch(some_observed(spark, 10 + epoch), paths[1], "q", epoch)
        same(spark, paths)


@pytest.fixture
def spec(spark):
    return ledger._by("incidents", "t_id", "weather_desc")


def test_a_refresh_reads_new_folders_only(spark, paths, monkeypatch, spec):
    read, plain = [], tables._read
    monkeypatch.setattr(tables, "_read", lambda *a: read.append([e["epoch"] for e in a[3]]) or plain(*a))
    for epoch in range(3):
        tables.write_epoch(some_joined(spark, epoch), paths[0], "q", epoch)
        found = ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec)
        files = found.inputFiles()
        assert files and all("/ledgers/incidents/parts/" in f and "/counts/" in f for f in files)
        ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec)
    assert read == [[0], [1], [2]]


def test_compaction_of_folded_folders_is_not_read_again(spark, paths, spec):
    for epoch in range(3):
        tables.write_epoch(some_joined(spark, epoch, day=epoch), paths[0], "q", epoch)
    before = tuples(ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec))
    assert tables.compact(spark, paths[0], tables.JOINED_TABLE, at(2 * 86_400).date())
    assert ledger.new_folders(spark, paths[0], 3) == ([], 3)
    assert tuples(ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec)) == before


def test_compaction_of_some_folded_folders_counts_nothing_twice(spark, paths, spec):
    tables.write_epoch(some_joined(spark, 0, 0), paths[0], "q", 0)
    ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec)
    tables.write_epoch(some_joined(spark, 1, 1), paths[0], "q", 1)
    tables.compact(spark, paths[0], tables.JOINED_TABLE, at(5 * 86_400).date())
    found = {r.weather_desc: r.n for r in ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec).collect()}
    rows = tables.read_joined(spark, paths[0]).collect()
    assert found == {w: len({r.t_id for r in rows if r.weather_desc == w} - {None}) for w in {r.weather_desc for r in rows}}


def test_many_parts_are_merged(spark, paths, monkeypatch, spec):
    monkeypatch.setattr(ledger, "MOST_PARTS", 2)
    for epoch in range(5):
        tables.write_epoch(some_joined(spark, epoch, count=8), paths[0], "q", epoch)
        found = tuples(ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec))
    assert len(ledger.manifest(spark, paths[0], spec)[1]["parts"]) <= 2
    rows = tables.read_joined(spark, paths[0]).collect()
    assert dict(found) == {w: len({r.t_id for r in rows if r.weather_desc == w} - {None}) for w in {r.weather_desc for r in rows}}
    assert ledger.drop_unlisted(spark, paths[0], spec) > 0
    assert tuples(ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec)) == found


def test_of_two_refreshes_at_a_time_one_begins_anew(spark, paths, monkeypatch, spec):
    tables.write_epoch(some_joined(spark, 1), paths[0], "q", 0)
    write, calls = storage.write_text, []

    def overtaken(spark_, path, text):
        if "/ledgers/" in path:
            calls.append(path)
            if len(calls) == 1:
                ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec)
                return False
        return write(spark_, path, text)

    monkeypatch.setattr(storage, "write_text", overtaken)
    ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec)
    assert len(ledger.manifest(spark, paths[0], spec)[1]["parts"]) == 1


def test_a_table_not_yet_written(spark, paths, spec):
    assert ledger.refresh(spark, paths[0], tables.JOINED_TABLE, spec).collect() == []
    assert ledger.rate_by_context(spark, *paths).collect() == []
    assert recent.history(spark, paths[0], 3)[0].collect() == []


def test_values_are_listed_by_folder(spark, paths, monkeypatch):
    tables.write_epoch(joined(spark, [("A", 0, "Minor", "Rain", 1), ("B", 0, None, "Rain", 1)]), paths[0], "q", 0)
    tables.write_epoch(joined(spark, [("A", 0, "New", "Rain", 1)]), paths[0], "q", 1)
    assert tables.listed_values(spark, paths[0]) == ["Minor", "New"]
    monkeypatch.setattr(tables, "MOST_VALUES", 1)
    many = joined(spark, [("A", 0, "X", "Rain", 1), ("A", 0, "Y", "Rain", 1)])
    tables.write_epoch(many, paths[0], "q", 2)
    with pytest.raises(ValueError):
        tables.listed_values(spark, paths[0])


@pytest.mark.parametrize("limit,first_null", [(1, 0), (1, 7), (7, 6), (25, 0), (1000, 0)])
def test_limited_history_is_that_of_the_whole_table(spark, folder, limit, first_null):
    base, pick = folder("joined"), random.Random(limit)
    for epoch in range(8):
        rows = [
            (f"I{pick.randrange(40)}" if k or epoch < first_null else None, epoch * 1000 + pick.randrange(1100), "Minor", "Rain", k)
            for k in range(12)
        ]
        tables.write_epoch(joined(spark, rows), base, "q", epoch)
    found, read = recent.history(spark, base, limit)
    whole = history.history(tables.read_joined(spark, base), limit)
    assert tuples(found) == tuples(whole)
    assert len(read) == len(set(read)) and (len(read) == 8 or limit < 1000)


def test_a_limit_that_cuts_reads_few_folders(spark, folder):
    base = folder("joined")
    for epoch in range(10):
        rows = [(f"I{epoch}-{k}", epoch * 1000 + k, "Minor", "Rain", 1) for k in range(10)]
        tables.write_epoch(joined(spark, rows), base, "q", epoch)
    found, read = recent.history(spark, base, 8)
    assert len(read) == 1
    assert [r.t_id for r in found.orderBy("t_start").collect()] == [f"I9-{k}" for k in range(2, 10)]
    _, read = recent.history(spark, base, 25)
    assert len(read) == 3


def test_a_key_of_an_unread_folder_is_not_new(spark, folder):
    base = folder("joined")
    tables.write_epoch(joined(spark, [("old", 0, "Minor", "Rain", 1), ("x", 1, "Minor", "Rain", 1)]), base, "q", 0)
    for epoch in range(1, 4):
        rows = [("old", epoch * 1000, "Minor", "Rain", 1), (f"I{epoch}", epoch * 1000, "Minor", "Rain", 1)]
        tables.write_epoch(joined(spark, rows), base, "q", epoch)
    found, read = recent.history(spark, base, 2)
    assert sorted(r.t_id for r in found.collect()) == ["I2", "I3"]
    assert len(read) == 3
