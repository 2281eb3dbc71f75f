import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contexture.llm import vector_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def around(pick, centre, cosines):
    """Vectors at given cosines to ``centre``, in random directions."""
    centre = centre / np.linalg.norm(centre)
    out = []
    for cosine in cosines:
        x = pick.normal(size=len(centre))
        x -= (x @ centre) * centre
        x /= np.linalg.norm(x)
        out.append(cosine * centre + math.sqrt(1 - cosine**2) * x)
    return out


def rows(dim=48, strangers=150, seed=3):
    pick = np.random.default_rng(seed)
    vectors = list(pick.normal(size=(strangers, dim)))
    for base in range(12):
        vectors += around(pick, vectors[base], pick.uniform(0.93, 0.9999, 6))
    vectors += around(pick, vectors[20], pick.uniform(0.985, 0.9999, 60))
    found = [(3 * k, [float(x) for x in np.float32(v)], k % 4) for k, v in enumerate(vectors)]
    found += [(5000 + k, found[k % 3][1], 0) for k in range(9)]
    found += [(1, [2 * x for x in found[5][1]], 1), (2, [-x for x in found[5][1]], 1)]
    awkward = [None, [], [0.0] * dim, [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    found += [(7000 + k, v, 1) for k, v in enumerate(awkward)]
    found += [(8000, [1.0], None), (8001, [0.5], None), (8002, [-1.0], None), (8003, [1e-30, 1e-30], 1), (8004, [1e30, 1e30], 1)]
    found += [(9, found[30][1], 1), (9, found[31][1], 1), (None, found[30][1], 1), (None, None, 1)]
    return found


def brute(rows):
    sound = [
        k for k, (i, v, _) in enumerate(rows)
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    unit = {k: np.array(rows[k][1], np.float64) for k in sound}
    unit = {k: v / np.abs(v).max() for k, v in unit.items()}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    near = {k: [o for o in sound if o != k and len(unit[o]) == len(unit[k]) and unit[o] @ unit[k] >= 0.95] for k in sound}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for other in near.get(todo.pop(), []):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        component = None if i is None else min(rows[o][0] for o in seen)
        out.append((i, len(near.get(k, [])), component, i is not None and i == component))
    return sorted(out, key=repr)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1024, 16])
def test_rows_are_those_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK_ROWS", chunk)
    found = vector_dedup.linked(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    assert listed(found) == brute(rows())


def test_vectors_shorter_than_a_code_and_longer(spark):
    for dim, seed in ((3, 1), (300, 2)):
        made = rows(dim, 60, seed)
        assert listed(vector_dedup.linked(spark.createDataFrame(made, SCHEMA))) == brute(made)


@pytest.mark.parametrize("dim", [20, 64, 700])
def test_estimates_are_unbiased_and_within_their_bounds(dim):
    pick = np.random.default_rng(dim)
    plan = vector_dedup.Plan(100_000)
    base = pick.normal(size=dim)
    vectors = np.array(around(pick, base, np.linspace(-0.9, 0.999, 1500)))
    unit = vector_dedup.unit_rows(np.vstack([base, vectors]))
    rotate = vector_dedup.Rotation(dim, plan.bits)
    rotated = rotate(unit)
    codes, factors = vector_dedup.encode(rotated)
    found, spread = vector_dedup.estimates(rotated[:1], codes, factors, rotate.components)
    off = (found[0] - unit @ unit[0])[1:] / spread[1:]
    assert abs(off.mean()) < 0.15 and np.abs(off).max() < vector_dedup.BOUND
    if plan.bits >= rotate.components:
        assert np.allclose((rotated**2).sum(axis=1), 1)


def test_few_pairs_are_recomputed():
    pick = np.random.default_rng(8)
    v = np.vstack([pick.normal(size=(500, 64)), np.array(around(pick, pick.normal(size=64), [0.99] * 10))])
    plan = vector_dedup.Plan(len(v))
    rotate = vector_dedup.Rotation(64, plan.bits)
    codes, factors = vector_dedup.encode(rotate(vector_dedup.unit_rows(v)))
    wanted = ~np.eye(len(v), dtype=bool)
    near, recomputed = vector_dedup.near_rows(v, codes, factors, wanted, plan)
    unit = vector_dedup.unit_rows(v)
    assert (near == ((unit @ unit.T >= 0.95) & wanted)).all() and near.any()
    assert near.sum() // 2 <= recomputed < near.sum()


def test_recall_of_pairs_at_the_threshold():
    """The part of pairs with a cosine of 0.95 that meet in a bucket with close codes."""
    pick = np.random.default_rng(1)
    for count in (1000, 50_000, 10**9):
        plan = vector_dedup.Plan(count)
        rotate = vector_dedup.Rotation(64, plan.bits)
        one = vector_dedup.unit_rows(pick.normal(size=(2000, 64)))
        two = np.vstack([around(pick, v, [0.95]) for v in one])
        bits = [rotate(v) > 0 for v in (one, two)]
        same = bits[0] == bits[1]
        bands = same[:, : plan.bands * plan.band].reshape(len(one), plan.bands, plan.band)
        close = (~same[:, : vector_dedup.BITS]).sum(axis=1) <= plan.most_bits
        assert (bands.all(axis=2).any(axis=1) & close).mean() > 0.99


def test_spanning_links_connect_what_the_matrix_connects():
    near = np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        near[a, b] = near[b, a] = True
    assert sorted(map(sorted, vector_dedup.spanning(near))) == [[0, 1], [0, 2], [4, 5]]


def test_extra_columns_with_clashing_names(spark):
    made = rows(16, 30)
    df = spark.createDataFrame(made, SCHEMA)
    for name in ("v", "id", "tie", "one", "two", "part", "copies", "key", "group", "component"):
        df = df.withColumn(name, F.lit("x"))
    assert listed(vector_dedup.linked(df)) == brute(made)


def test_empty_table(spark):
    assert vector_dedup.linked(spark.createDataFrame([], SCHEMA)).collect() == []
    assert listed(vector_dedup.linked(spark.createDataFrame([(1, None, 1)], SCHEMA))) == [(1, 0, 1, True)]
