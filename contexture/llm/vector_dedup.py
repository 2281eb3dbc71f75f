"""Near copies among embeddings, by binary codes of randomised rotations.

Every distinct vector, at unit length, is rotated by seeded random rotations and
keeps the signs of the rotated components as its code, along with a correction
factor: the inner product ``f`` of the vector and its code (at unit length too).
For another vector ``q``, ``<code, q> / f`` is an unbiased estimate of their inner
product, whose error has a spread of ``sqrt((1 - f^2) / f^2 / (M - 1))`` for ``M``
rotated components. A pair whose estimate lies more than ``BOUND`` spreads below
the threshold is dropped; every other pair is recomputed in double precision.

Which pairs are looked at: bits of the code in bands are bucket keys. A pair at the
threshold shares a bit with probability ``1 - acos(0.95) / pi`` and so a band of
``b`` bits with that to the power of ``b``; there are as many bands as make missing
all of them less likely than ``MISS``, and ``b`` grows with the logarithm of the
number of vectors, so that a bucket holds about ``BUCKET`` strangers at any size.
Only codes go to the buckets. Codes there with few enough different bits tie their
vectors together; vectors so tied, at any remove, are a group, and only vectors of
groups travel, once, to be compared as above. Neither step emits pairs: a task
gives its vectors' numbers of links and as few links as connect what all of its
links connect.

Exact copies are one vector and come in as a number. A bucket or group too large for
a task is cut into chunks by hash, and every pair of chunks is compared, so a group of
very many different near copies costs the square of its number of chunks.

Defined results: a vector that is null, empty, zero, or has a null, NaN or infinite
component has no links and is its own component; vectors of different lengths do not
link; rows of one vec_id are vectors of their own, and so are repeated rows, which
link; a row without vec_id has no links, no component and is not kept; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contexture.llm.components import components
from contexture.llm.tables import written

THRESHOLD = 0.95
#: Chance that a pair at the threshold meets in no bucket, and strangers in a bucket.
MISS = 1e-3
BUCKET = 16
#: Spreads that an estimate may be off, and those that the number of different bits may be.
BOUND = 5.0
BITS = 256
#: Rows of one chunk of a bucket or a group.
CHUNK_ROWS = 1024
SEED = 12

CODED_SCHEMA = "id bigint, tie bigint, copies bigint, v array<double>, code binary, factor double, keys array<bigint>"
TIE_SCHEMA = "a_id bigint, a_tie bigint, b_id bigint, b_tie bigint"
LINK_SCHEMA = "id bigint, tie bigint, links bigint, b_id bigint, b_tie bigint"


class Plan:
    """Sizes of codes, bands and bounds for so many vectors."""

    def __init__(self, vectors: int, threshold: float = THRESHOLD):
        self.threshold = threshold
        apart = math.acos(threshold) / math.pi
        self.band = min(40, max(8, math.ceil(math.log2(max(vectors, 1) / BUCKET + 1))))
        self.bands = math.ceil(math.log(MISS) / math.log1p(-((1 - apart) ** self.band)))
        self.bits = 64 * math.ceil(max(BITS, self.band * self.bands) / 64)
        spread = math.sqrt(BITS * apart * (1 - apart))
        #: Different bits among the first ``BITS`` that a pair may have to be tied.
        self.most_bits = math.ceil(BITS * apart + BOUND * spread)


class Rotation:
    """Seeded rotations of vectors of one length, end to end.

    A rotation is three rounds of random signs and a Walsh-Hadamard transform, so
    it takes no matrix, whatever the length.
    """

    def __init__(self, dim: int, bits: int):
        self.dim, self.bits = dim, bits
        self.padded = max(64, 1 << (dim - 1).bit_length())
        self.times = -(-bits // self.padded)
        pick = np.random.default_rng([SEED, dim])
        self.signs = pick.integers(0, 2, (self.times, 3, self.padded)) * 2.0 - 1

    @property
    def components(self) -> int:
        return self.times * self.padded

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """The first ``bits`` rotated components of each row; all of them are of unit length."""
        out = []
        for rounds in self.signs:
            x = np.zeros((len(unit), self.padded))
            x[:, : self.dim] = unit
            for signs in rounds:
                x = _hadamard(x * signs)
            out.append(x)
        return np.concatenate(out, axis=1)[:, : self.bits] / math.sqrt(self.times)


def _hadamard(x: np.ndarray) -> np.ndarray:
    rows, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(rows, size) / math.sqrt(size)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as packed bits, and correction factors."""
    factors = np.abs(rotated).sum(axis=1) / math.sqrt(rotated.shape[1])
    return np.packbits(rotated > 0, axis=1), factors


def estimates(
    rotated: np.ndarray, codes: np.ndarray, factors: np.ndarray, components: int
) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rotated rows with coded vectors, and the spread of a column's error."""
    bits = rotated.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    found = (rotated.astype(np.float32) @ signs.T) / (math.sqrt(bits) * factors[None, :])
    return found, np.sqrt((1 - factors**2).clip(0) / factors**2 / (components - 1))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def usable(vec_id: str, v: str) -> Column:
    """Whether a row takes part."""
    return F.expr(
        f"{vec_id} IS NOT NULL AND {v} IS NOT NULL AND exists({v}, x -> x <> 0) AND "
        f"forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1.7976931348623157e308D)"
    )


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``one, two, id, copies, v``: a row per distinct vector, named by a hash of 128 bits.

    Copies are counted where they are before they are shuffled.
    """
    return rows.groupBy("one", "two").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")
    )


def coded(vectors: DataFrame, plan: Plan) -> DataFrame:
    """``CODED_SCHEMA`` of ``id, tie, copies, v``; keys are the bands of the code."""
    rotations: dict[int, Rotation] = {}
    weights = 1 << np.arange(plan.band, dtype=np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                rows = batch.take(pa.array(own))
                rotate = rotations.setdefault(int(dim), Rotation(int(dim), plan.bits))
                codes, factors = encode(rotate(unit_rows(_matrix(rows.column("v")))))
                used = np.unpackbits(codes, axis=1)[:, : plan.bands * plan.band]
                keys = used.reshape(len(own), plan.bands, plan.band) @ weights
                ends = np.arange(len(own) + 1, dtype=np.int32) * plan.bands
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                columns = [*rows.columns, pa.array([c.tobytes() for c in codes], pa.binary())]
                columns += [pa.array(factors), listed]
                names = ["id", "tie", "copies", "v", "code", "factor", "keys"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.select("id", "tie", "copies", "v").mapInArrow(code, CODED_SCHEMA)


def in_chunks(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``i``, ``j`` and ``late``: those of a key in order, ready for a task.

    Keys with one row are left out. A key with more than ``CHUNK_ROWS`` is cut into
    chunks by hash, and its rows are there for every pair ``i <= j`` of chunks that
    has theirs; ``late`` marks those of chunk j where the two differ.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.select(key, F.ceil(F.col("size") / CHUNK_ROWS).cast("int").alias("chunks"))
    rows = rows.join(sizes, key)
    own = F.pmod(F.xxhash64("id", "tie"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other).drop("chunks")
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.withColumn("late", F.expr("own > other")).drop("own", "other")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "id", "tie")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole runs of (key, i, j), each with two rows or more."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        begins = _begins(table, key)
        for begin, end in zip(begins[:-1], begins[1:], strict=True):
            if end - begin > 1:
                yield table.slice(begin, end - begin)
        held = table.slice(begins[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _begins(table: pa.Table, key: str) -> list[int]:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in (key, "i", "j"):
        own = table.column(name).to_numpy()
        new[1:] |= own[1:] != own[:-1]
    return np.flatnonzero(new).tolist()


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Few links that connect the rows which the symmetric matrix ``near`` connects."""
    open_ = np.ones(len(near), dtype=bool)
    edges = []
    for start in range(len(near)):
        if not open_[start]:
            continue
        open_[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & open_)
            open_[found] = False
            edges += [(at, int(other)) for other in found]
            todo += found.tolist()
    return edges


def _across(late: np.ndarray) -> np.ndarray:
    """Which pairs of a run are its own: all of one chunk, or those of two chunks."""
    own = late[:, None] != late[None, :] if late.any() else np.ones((len(late),) * 2, dtype=bool)
    np.fill_diagonal(own, False)
    return own


def _different_bits(codes: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(codes).view(np.uint64)
    out = np.zeros((len(words),) * 2, dtype=np.uint16)
    for k in range(words.shape[1]):
        out += np.bitwise_count(words[:, None, k] ^ words[None, :, k])
    return out


def ties(keyed: DataFrame, plan: Plan) -> DataFrame:
    """``TIE_SCHEMA``: links that connect vectors whose codes are close in a bucket."""
    buckets = keyed.select(
        "id",
        "tie",
        F.substring("code", 1, BITS // 8).alias("code"),
        F.size("v").alias("dim"),
        F.posexplode("keys").alias("band", "key"),
    )
    buckets = buckets.select("id", "tie", "code", F.xxhash64("dim", "band", "key").alias("bucket"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for run in _runs(batches, "bucket"):
            near = _different_bits(_bytes(run.column("code"))) <= plan.most_bits
            near &= _across(run.column("late").to_numpy(zero_copy_only=False))
            if near.any():
                names = np.stack([run.column(c).to_numpy() for c in ("id", "tie")], axis=1)
                edges = np.array(spanning(near))
                parts.append(np.concatenate([names[edges[:, 0]], names[edges[:, 1]]], axis=1))
            if len(parts) >= 4096:
                yield _columns(np.unique(np.concatenate(parts), axis=0), TIE_SCHEMA)
                parts = []
        if parts:
            yield _columns(np.unique(np.concatenate(parts), axis=0), TIE_SCHEMA)

    return in_chunks(buckets, "bucket").mapInArrow(compare, TIE_SCHEMA).distinct()


def _columns(rows: np.ndarray, schema: str) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=names)


def near_rows(
    v: np.ndarray, codes: np.ndarray, factors: np.ndarray, wanted: np.ndarray, plan: Plan
) -> tuple[np.ndarray, int]:
    """Symmetric matrix of links among ``wanted`` pairs, and how many were recomputed."""
    unit = unit_rows(v)
    rotate = Rotation(v.shape[1], plan.bits)
    found, spread = estimates(rotate(unit), codes, factors, rotate.components)
    open_ = wanted & (found + BOUND * spread[None, :] >= plan.threshold)
    one, two = np.nonzero(np.triu(open_ & open_.T))
    near = np.zeros(open_.shape, dtype=bool)
    # A row at a time, so the products of few pairs are held together.
    cuts = np.searchsorted(one, np.arange(len(v) + 1))
    for row in np.flatnonzero(np.diff(cuts)):
        others = two[cuts[row] : cuts[row + 1]]
        near[row, others] = unit[others] @ unit[row] >= plan.threshold
    return near | near.T, len(one)


def links(groups: DataFrame, plan: Plan) -> DataFrame:
    """``LINK_SCHEMA``: numbers of links of the vectors of groups, and links that connect them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in LINK_SCHEMA.split(", ")]
        for run in _runs(batches, "group"):
            wanted = _across(run.column("late").to_numpy(zero_copy_only=False))
            near, _ = near_rows(
                _matrix(run.column("v")),
                _bytes(run.column("code")),
                run.column("factor").to_numpy(),
                wanted,
                plan,
            )
            if not near.any():
                continue
            ids, tie_of = (run.column(name).to_numpy() for name in ("id", "tie"))
            counted = near.astype(np.int64) @ run.column("copies").to_numpy()
            own = np.flatnonzero(counted)
            edges = np.array(spanning(near))
            none = pa.nulls(len(own), pa.int64())
            parts = [
                [pa.array(ids[own]), pa.array(tie_of[own]), pa.array(counted[own]), none, none],
                [
                    *(pa.array(x[edges[:, 0]]) for x in (ids, tie_of)),
                    pa.array(np.zeros(len(edges), np.int64)),
                    *(pa.array(x[edges[:, 1]]) for x in (ids, tie_of)),
                ],
            ]
            for columns in parts:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_chunks(groups, "group").mapInArrow(compare, LINK_SCHEMA)


def _node(id_: str, tie: str) -> Column:
    return F.struct(F.col(id_).alias("id"), F.col(tie).alias("tie"))


def linked(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: a row per row of ``vectors``."""
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")
    )
    rows = rows.withColumn("part", F.coalesce(usable("vec_id", "v"), F.lit(False)))
    names = [F.when(F.col("part"), F.xxhash64("v", F.lit(k))).alias(n) for k, n in enumerate(["one", "two"])]
    rows = rows.select("vec_id", "v", "part", *names)
    classes = distinct_vectors(rows.where("part"))
    classes = written(classes.withColumn("tie", F.col("one")), "vectors")
    plan = Plan(classes.count(), threshold)
    keyed = written(coded(classes, plan), "codes")
    tied = ties(keyed, plan).select(_node("a_id", "a_tie").alias("a"), _node("b_id", "b_tie").alias("b"))
    named = components(tied).select("node.*", F.xxhash64("component").alias("group"))
    groups = keyed.join(named, ["id", "tie"]).drop("keys")
    found = written(links(groups, plan), "links")
    numbers = found.groupBy("id", "tie").agg(F.sum("links").alias("links"))
    met = found.where("b_id IS NOT NULL")
    met = met.select(_node("id", "tie").alias("a"), _node("b_id", "b_tie").alias("b"))
    least = components(met).select("node.*", F.col("component.id").alias("least"))
    own = classes.join(numbers, ["id", "tie"], "left").join(least, ["id", "tie"], "left")
    own = own.selectExpr(
        "one",
        "two",
        "copies - 1 + coalesce(links, 0) AS n_links",
        "coalesce(least, id) AS component_id",
    )
    out = rows.drop("v").join(own, ["one", "two"], "left")
    component = F.when(F.col("part"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
