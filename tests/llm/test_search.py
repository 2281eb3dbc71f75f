import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contexture.llm import search

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(count=400, dim=6):
    pick = np.random.default_rng(5)
    rows = [(k, [float(x) for x in pick.normal(0, 0.3, dim).astype(np.float32)], 1) for k in range(count)]
    rows += [(1000 + k, rows[7][1], 1) for k in range(30)]  # copies: ties
    rows += [(2000, None, 1), (2050, [1.0] * 5 + [None], 1), (2100, [math.nan] * dim, 1), (2150, [math.inf] + [0.0] * 5, 1)]
    rows += [(None, rows[0][1], 1), (50, rows[3][1], 1), (2200, [1.0, 2.0], 1), (2250, [1.0, 3.0], 1)]
    return rows


def brute(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, done = [], set()
    for query, q in usable:
        if query % 50 or query in done:
            continue
        done.add(query)
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in usable if i != query and len(v) == len(q))
        out += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(8192, 1024), (60, 3)])
def test_hits_are_those_of_brute_force(spark, monkeypatch, shard_rows, block_rows):
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(search, "BLOCK_ROWS", block_rows)
    rows = [r for r in vectors() if not (r[0] == 50 and r[1] == vectors()[3][1])]
    found = search.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_a_repeated_query_is_asked_once(spark):
    found = search.top_k(spark.createDataFrame(vectors(), SCHEMA), F.col("vec_id") == 50)
    assert found.count() == 5 and found.where("vec_id = 50").count() == 0


def test_scores_beyond_exact_floats():
    q = np.array([[2.0**40, 1.0]])
    assert search._score(q, np.array([[2.0**13, 3.0]])).tolist() == [[2**53 + 3]]


def test_empty_table(spark):
    assert search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_all_rows_of_a_query_are_asked(spark, monkeypatch, shard_rows):
    """As the SQL: rows of one id with other vectors, and copies, rank together."""
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(search, "BLOCK_ROWS", 3)
    rows = vectors()
    rows += [rows[100]] * 3 + [rows[7]] * 9 + [(150, rows[k][1], 1) for k in range(200, 300)]
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for query in {i for i, _ in usable if i % 50 == 0}:
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=True)), i)
            for own, q in usable if own == query
            for i, v in usable if i != query and len(v) == len(q)
        )
        expected += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    for parts in (1, 7):
        found = search.top_k(spark.createDataFrame(rows, SCHEMA).repartition(parts), F.col("vec_id") % 50 == 0)
        assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 50)
    rows = [(1, [float(k), 1.0], 1) for k in range(1000)] + [(2, [1.0, 1.0], 1)] * 1000
    index, _ = search.trees(spark.createDataFrame(rows, SCHEMA))
    sizes = [len(r["ids"]) // 8 for r in index.select("ids").collect()]
    assert sum(sizes) == 1005 and max(sizes) < 100


def test_large_finite_components_have_a_result(spark):
    rows = [(0, [1e17], 1), (1, [2e17], 1), (2, [-3e17], 1), (3, [0.5], 1), (50, [2.0**40], 1), (51, [-1e-3], 1)]
    rows += [(100, [1e300, -1e300], 1), (101, [1e300, 1e300], 1), (102, [1e300, -1.0], 1), (103, [1.5e308, 1.0], 1)]
    schema = "vec_id bigint, embedding array<double>, label int"

    def bounded(x):
        return min(max(x, -(2**63)), 2**63 - 1)

    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if all(math.isfinite(256 * x) for x in v)]
    expected = []
    for query, q in usable:
        if query % 50 == 0:
            scored = sorted(
                (-bounded(sum(a * b for a, b in zip(q, v, strict=True))), i)
                for i, v in usable
                if i != query and len(v) == len(q)
            )
            expected += [(query, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    found = search.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_blocks_sent_to_every_shard_are_not_broadcast(spark, check_plan, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 60)
    table = spark.createDataFrame(vectors(), SCHEMA)
    index, shards = search.trees(table)
    queries = search._copies(search._usable(table.where("vec_id % 50 = 0"), "vec_id", "embedding"), 5)
    queries = queries.selectExpr("vec_id", "v", "copies", "size(v) AS dim", "0L AS block", "0L AS floor")
    plan = check_plan(search._pass(index, shards, search.written(queries, "queries"), 5, True))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
