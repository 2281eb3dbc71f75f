"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors are cut into shards of bounded size, and every shard becomes a ball tree:
a node has a centre and a radius, and no vector under it has a larger inner
product with query q than ``q . centre + |q| * radius``. A query looks into the
leaf with the largest bound first; then the leaves are taken one by one, each with
all queries whose bound there is not below their current kth score; ties go on, so
equal scores are all seen.

The kth score is shared between shards: a first pass looks only into each shard's
most promising leaf, and the kth best of all these, a lower bound of the true
one, is where the second pass starts. Queries travel in blocks, so a task holds a
tree and one block of queries, however many there are.

Components are floor(256 * x) of doubles, and scores are sums of products in
64-bit floats, which are exact up to 2^53; vectors whose scores could be larger
are scored in Python integers. A score that 64 bits cannot hold reads as the
largest or the least number that they can.

Defined results: a vector that is null, or has a null, NaN or infinite component
(or one that is infinite when taken 256 times), takes no part; an empty vector scores 0 with others like it; vectors of different
lengths do not meet; ties go to the smaller vec_id; a repeated row is a candidate
of its own (not for the query with its own id); all rows of a wanted vec_id are
asked, copies too, and their hits are ranked together; a null vec_id takes no part;
fewer candidates than k give fewer rows. Extra columns are not read.

No more than k copies of a row can come to a result, on either side, so copies
beyond these are dropped first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contexture.llm.tables import written

K = 5
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LEAF_ROWS = 64
SCALE = 256

TREE_SCHEMA = (
    "dim int, shard bigint, ids binary, vectors binary, begins binary, centres binary, radii binary"
)
HIT_SCHEMA = "query_id bigint, vec_id bigint, score bigint"
_EXACT = float(1 << 53)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` with whole-numbered components as doubles."""
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("v"),
    )
    sound = f"forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs({SCALE}D * x) <= 1.7976931348623157e308D)"
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(sound)
    # From 2^53 on a double is whole, and Spark's floor is a 64-bit number.
    whole = f"IF(abs({SCALE}D * x) < 9e15D, CAST(floor({SCALE}D * x) AS DOUBLE), {SCALE}D * x)"
    return rows.withColumn("v", F.expr(f"transform(v, x -> {whole})"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim) if dim else np.zeros((len(column), 0))


def _ordered(v: np.ndarray, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows cut into leaves: again and again along the line between two far points."""
    todo, out = [rows], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf or v.shape[1] == 0:
            out.append(own)
            continue
        points = v[own]
        one = points[np.argmax(((points - points[0]) ** 2).sum(axis=1))]
        two = points[np.argmax(((points - one) ** 2).sum(axis=1))]
        order = np.argsort(points @ (one - two), kind="stable")
        half = len(own) // 2
        todo += [own[order[half:]], own[order[:half]]]
    return out


def _tree(key: tuple, rows: pa.Table) -> pa.Table:
    """The tree of one shard, as arrays: leaves end to end with centres and radii."""
    dim, shard = (part.as_py() for part in key)
    ids = rows.column("vec_id").to_numpy()
    v = _matrix(rows.column("v").combine_chunks(), dim)
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    old = np.seterr(over="ignore", invalid="ignore")
    leaves = _ordered(v, np.arange(len(ids)), LEAF_ROWS)
    begins = np.concatenate([[0], np.cumsum([len(leaf) for leaf in leaves])])
    centres = np.stack([v[leaf].mean(axis=0) for leaf in leaves])
    radii = np.array(
        [np.sqrt(((v[leaf] - c) ** 2).sum(axis=1).max()) for leaf, c in zip(leaves, centres, strict=True)]
    )
    np.seterr(**old)
    order = np.concatenate(leaves)
    data = [ids[order], v[order], begins.astype(np.int64), centres, radii]
    columns = [pa.array([dim], pa.int32()), pa.array([shard], pa.int64())]
    columns += [pa.array([np.ascontiguousarray(part).tobytes()], pa.binary()) for part in data]
    names = [part.split()[0] for part in TREE_SCHEMA.split(", ")]
    return pa.Table.from_arrays(columns, names=names)


def _copies(rows: DataFrame, k: int) -> DataFrame:
    """Distinct rows with the number of their copies, ``k`` at most."""
    found = rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    return found.withColumn("copies", F.expr(f"CAST(least(copies, {k}) AS INT)"))


def trees(
    vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, int]:
    """The index, a row per shard of about ``SHARD_ROWS`` vectors, and the number of shards."""
    rows = _usable(vectors, vec_id, embedding)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    copies = F.expr("explode(sequence(1, copies))")
    rows = _copies(rows, k).select("vec_id", "v", copies, F.size("v").alias("dim")).drop("col")
    # Copies of one vector are spread like others, and so are the rows of one id.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)))
    made = rows.groupBy("dim", "shard").applyInArrow(_tree, TREE_SCHEMA)
    return written(made, "trees"), shards


def _blocks(key: tuple, rows: pa.Table) -> pa.Table:
    dim, block = (part.as_py() for part in key)
    rows = rows.sort_by("vec_id")
    v = _matrix(rows.column("v").combine_chunks(), dim)
    columns = [pa.array([dim], pa.int32()), pa.array([block], pa.int64())]
    columns += [
        pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())
        for part in (
            rows.column("vec_id").to_numpy(),
            v,
            rows.column("floor").to_numpy(),
            rows.column("copies").to_numpy(),
        )
    ]
    names = ["dim", "block", "queries", "points", "floors", "copies"]
    return pa.Table.from_arrays(columns, names=names)


BLOCK_SCHEMA = "dim int, block bigint, queries binary, points binary, floors binary, copies binary"


def _score(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    with np.errstate(over="ignore"):
        largest = np.abs(q).sum(axis=1).max() * np.abs(v).max()
    if largest < _EXACT:
        return (q @ v.T).astype(np.int64)
    exact_q = [[int(x) for x in row] for row in q]
    exact_v = [[int(x) for x in row] for row in v]
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array(
        [
            [min(max(sum(a * b for a, b in zip(x, y, strict=True)), least), most) for y in exact_v]
            for x in exact_q
        ],
        dtype=np.int64,
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, then id."""
    return np.lexsort((ids, ~scores))[:k]  # ~x orders as -x does, and has no overflow


def _visit(row: dict, k: int, first_only: bool) -> tuple[list, list, list]:
    """Hits of a block of queries in one tree."""
    dim = row["dim"]
    ids = np.frombuffer(row["ids"], np.int64)
    v = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), dim)
    begins = np.frombuffer(row["begins"], np.int64)
    centres = np.frombuffer(row["centres"], np.float64).reshape(len(begins) - 1, dim)
    radii = np.frombuffer(row["radii"], np.float64)
    queries = np.frombuffer(row["queries"], np.int64)
    q = np.frombuffer(row["points"], np.float64).reshape(len(queries), dim)
    floors = np.frombuffer(row["floors"], np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((q * q).sum(axis=1))
        # The bound is raised a little, so rounding never hides a leaf; one beyond
        # all doubles hides none.
        bounds = q @ centres.T + norms[:, None] * radii
        bounds += 1e-9 * (1 + np.abs(bounds) + norms[:, None] * radii)
    bounds[~np.isfinite(bounds)] = np.inf
    found: list[tuple[np.ndarray, np.ndarray]] = [
        (np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries
    ]
    kth = floors.copy()

    def look(leaf: int, own: np.ndarray) -> None:
        """Those of the queries ``own`` that have hits in a leaf take them."""
        part = slice(begins[leaf], begins[leaf + 1])
        scores = _score(q[own], v[part])
        keep = (scores >= kth[own][:, None]) & (ids[part] != queries[own][:, None])
        for at in np.flatnonzero(keep.any(axis=1)):
            query = own[at]
            all_scores = np.concatenate([found[query][0], scores[at][keep[at]]])
            all_ids = np.concatenate([found[query][1], ids[part][keep[at]]])
            best = _best(all_scores, all_ids, k)
            found[query] = all_scores[best], all_ids[best]
            if len(best) == k:
                kth[query] = max(kth[query], int(all_scores[best[-1]]))

    promising = bounds.argmax(axis=1)
    for leaf in np.unique(promising):
        own = np.flatnonzero((promising == leaf) & (bounds[:, leaf] >= kth))
        if len(own):
            look(leaf, own)
    for leaf in [] if first_only else np.argsort(-bounds.max(axis=0), kind="stable"):
        own = np.flatnonzero((promising != leaf) & (bounds[:, leaf] >= kth))
        if len(own):
            look(leaf, own)
    # A query asked by several rows has each hit as many times, of which k can count.
    copies = np.frombuffer(row["copies"], np.int32)
    found = [
        (np.repeat(scores, own)[:k], np.repeat(hits, own)[:k])
        for (scores, hits), own in zip(found, copies, strict=True)
    ]
    sizes = [len(scores) for scores, _ in found]
    return (
        np.repeat(queries, sizes),
        np.concatenate([own for _, own in found] or [[]]).astype(np.int64),
        np.concatenate([own for own, _ in found] or [[]]).astype(np.int64),
    )


def _pass(
    index: DataFrame, shards: int, queries: DataFrame, k: int, first_only: bool
) -> DataFrame:
    """Each block of queries through each tree of its length.

    A block is sent to every shard by number and meets its tree there. The blocks are
    not broadcast: Spark sizes them by the file of queries, without their copies for
    every shard, and would hold all of these in the driver.
    """
    blocks = queries.groupBy("dim", "block").applyInArrow(_blocks, BLOCK_SCHEMA)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = _visit(batch.slice(at, 1).to_pylist()[0], k, first_only)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part) for part in found], names=["query_id", "vec_id", "score"]
                )

    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = sent.withColumn("shard", F.col("shard").cast("bigint"))
    return sent.hint("merge").join(index, ["dim", "shard"]).mapInArrow(visit, HIT_SCHEMA)


def _top(hits: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    wanted: Column,
    k: int = K,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows ``wanted`` the k best of all others."""
    index, shards = trees(vectors, k, vec_id, embedding)
    queries = _usable(vectors.where(wanted), vec_id, embedding)
    queries = _copies(queries, k).withColumn("dim", F.size("v"))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    queries = written(queries, "queries")
    lowest = -(1 << 63)
    early = _top(_pass(index, shards, queries.withColumn("floor", F.lit(lowest)), k, True), k)
    floors = early.where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("floor")
    )
    floors = queries.join(floors, "vec_id", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(lowest))
    )
    hits = _top(_pass(index, shards, written(floors, "floors"), k, False), k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
