import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contexture.llm import ngram_join
from contexture.llm.components import components
from tests.llm.helpers import BLANK, awkward, frame, listed, lower, prose


def shingles(text):
    own = BLANK.findall(lower(text))
    if len(own) < 5:
        return {tuple(own)} if own else set()
    return {tuple(own[k : k + 5]) for k in range(len(own) - 4)}


def groups(sets):
    label = list(range(len(sets)))
    for i, one in enumerate(sets):
        for j in range(i):
            if one and 100 * len(one & sets[j]) >= 75 * len(one | sets[j]):
                a, b = label[i], label[j]
                label = [b if own == a else own for own in label]
    return label


def brute(rows):
    sets = [shingles(text) for _, text, *_ in rows]
    label = groups(sets)
    out = []
    for k, (doc_id, *_) in enumerate(rows):
        named = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        least = min(named, default=None) if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), least))
    return sorted(out, key=repr)


def edited(seed):
    """Copies with more and less of them changed, so that links chain."""
    rows, base = [], prose(seed, 60).split()
    pick = np.random.default_rng(seed)
    for k in range(25):
        own = list(base)
        for at in pick.integers(0, len(own), int(pick.integers(0, 4))):
            own[at] = f"w{pick.integers(0, 5)}"
        rows.append((1000 * seed + k, " ".join(own), "en", "x", 0))
    return rows


def test_components_are_those_of_brute_force(spark):
    rows = awkward() + edited(1) + edited(2)
    found = ngram_join.linked(frame(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_cut_lists_and_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 4)
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 300)
    rows = edited(3) + edited(4)
    found = ngram_join.linked(frame(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    rows = awkward()
    docs = frame(spark, rows).withColumnRenamed("lang", "class")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    label = groups([shingles(text) for _, text, *_ in rows])
    empty = sum(not shingles(text) for _, text, *_ in rows)
    full = {own for own, (_, text, *_) in zip(label, rows, strict=True) if shingles(text)}
    assert kept.count() == len(full) + empty


def test_names_of_its_own_may_be_taken(spark):
    docs = frame(spark, awkward())
    taken = docs.selectExpr("*", "1 AS _kept_id", "'x' AS _KEPT_PRINT", "2 AS _rows")
    kept = ngram_join.one_of_each(taken)
    assert kept.columns == taken.columns
    plain = ngram_join.one_of_each(docs)
    assert listed(kept.select(docs.columns)) == listed(plain)


def test_empty_table(spark):
    assert ngram_join.linked(frame(spark, [])).collect() == []
    assert ngram_join.one_of_each(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=2, max_size=12))
def test_trie_connects_what_links_connect(sets):
    sets = [set(own) for own in {frozenset(own) for own in sets}]
    if len(sets) < 2:
        return
    arrays = [np.array(sorted(own), dtype=np.uint64) for own in sets]
    label = list(range(len(sets)))
    for a, b in ngram_join.Trie(arrays).links():
        label = [label[a] if own == label[b] else own for own in label]
    expected = groups(sets)
    assert [[a == b for b in label] for a in label] == [[a == b for b in expected] for a in expected]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 200), min_size=1, max_size=40), min_size=2, max_size=10))
def test_bitmaps_never_rule_out_a_link(sets):
    mixed = [np.sort(ngram_join.words.mix(np.array(sorted(own), dtype=np.uint64))) for own in sets]
    ids = np.arange(len(sets))
    n = np.array([len(own) for own in mixed])
    edges = ngram_join.candidate_edges(ids, n, [ngram_join.bitmap(own) for own in mixed], ids.copy())
    label = list(range(len(sets)))
    for a, b in edges:
        label = [label[a] if own == label[b] else own for own in label]
    for i, one in enumerate(sets):
        for j, two in enumerate(sets):
            if 100 * len(one & two) >= 75 * len(one | two):
                assert label[i] == label[j]


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (5, 5)], [(k, k + 1) for k in range(40)]])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["component"] for r in found.collect()} == label


@pytest.mark.parametrize("pair_words,batch_rows", [(1 << 20, 1000), (2, 7)])
def test_short_lists_are_compared_many_at_once(monkeypatch, pair_words, batch_rows):
    pick = np.random.default_rng(3)
    columns, wanted = {name: [] for name in ("token", "i", "j", "set_id", "n", "bits", "label")}, []
    for token in range(60):
        size, base = int(pick.integers(1, 9)), pick.integers(1 << 40, size=int(pick.integers(1, 200)))
        sets = []
        for _ in range(size):
            own = base[pick.random(len(base)) < pick.choice([0.5, 0.97])]
            sets.append(np.unique(np.append(own, pick.integers(1 << 40, size=int(pick.integers(1, 4))))).astype(np.uint64))
        ids = np.arange(1000 * token, 1000 * token + size)
        labels, n = pick.integers(3, size=size) + 7, np.array([len(own) for own in sets])
        bits = [ngram_join.bitmap(own) for own in sets]
        wanted += ngram_join.candidate_edges(ids, n, bits, labels)
        for row in zip([token] * size, [0] * size, [0] * size, ids, n, bits, labels, strict=True):
            for column, value in zip(columns.values(), row, strict=True):
                column.append(value)
    table = pa.table(columns)

    def one_by_one(*_):
        raise AssertionError("a short list on its own")

    monkeypatch.setattr(ngram_join, "candidate_edges", one_by_one)
    monkeypatch.setattr(ngram_join, "PAIR_WORDS", pair_words)
    found = [
        edge
        for batch in ngram_join._list_edges(iter(table.to_batches(max_chunksize=batch_rows)))
        for edge in zip(*(column.to_pylist() for column in batch.columns), strict=True)
    ]
    names = {k: (k // 1000, int(label)) for k, label in zip(columns["set_id"], columns["label"], strict=True)}
    assert wanted and _groups(found, names) == _groups(wanted, names)


def _groups(edges, names):
    """Which labels of a list the edges make one."""
    least = {name: name for name in names.values()}
    for _ in range(len(least)):
        for a, b in edges:
            least[names[a]] = least[names[b]] = min(least[names[a]], least[names[b]])
    return least
