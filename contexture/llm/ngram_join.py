"""Documents linked by the Jaccard similarity of their word n-grams.

Two documents link when ``100 * intersection >= 75 * union`` of their sets of
distinct five-word shingles. The join is a prefix-tree join in two steps.

*Blocks.* Every shingle has a place in one global order, rare before frequent
(frequencies of all shingles of all documents, added up in a sketch of fixed
size; the sketch sets the order only, so its errors cost time and never links).
Two sets that link share a shingle among the first ``n - ceil(0.75 n) + 1`` of
each, so sets are brought together by these. A bitmap of one or two bits a shingle then
rules out most pairs: the sets differ in at least as many shingles as the
bitmaps in bits. What remains connects sets into blocks. Before that, sets that
share one of a few least shingles under random orders are connected the same
way, so that large groups of copies cost a comparison each and not one a pair.

*Tries.* A block's sets go, once each, into a trie in the block's order,
frequent before rare, where sets that begin alike share their beginning. A set
walks the trie, carrying the overlap so far, and leaves a subtree that its
remaining length cannot lift to a link, or whose sets it is already connected
to. Large blocks are cut into chunks, and each pair of chunks is worked alone.

Equal sets are one set throughout. Sets are known by 64-bit hashes; that two
different ones share a hash is checked for and raises.

Defined results: a text without words (null, empty, blank) has no shingles and
links with nothing; a text of fewer than five words has one, its whole sequence;
a repeated row is a document of its own; a null doc_id is a document that never
gives a component its name (a component of only such has null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contexture.llm import words
from contexture.llm.components import components
from contexture.llm.tables import free_name, written

SIZE = 5
PERCENT = 75
SKETCH_BITS = 18
KEYS = 3
LIST_ROWS = 2048
SHORT_LIST = 32
PAIR_WORDS = 1 << 20
CHUNK_SHINGLES = 1 << 20

_STEP = 0xD1B54A32D192ED03
_SKETCH_ROW = 1 << 14


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The fewest shingles a set of ``n`` shares with one it links to."""
    return -(-percent * n // 100)


def shingle_sets(
    raw: np.ndarray, offsets: np.ndarray, size: int = SIZE
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and where each begins."""
    starts, ends, first = words.spans(raw, offsets, words.NOT_BLANK)
    found = words.hashes(raw, starts, ends)
    rolled = np.zeros(max(0, len(found) - size + 1), dtype=np.uint64)
    for k in range(size):
        factor = np.uint64(pow(_STEP, k, 1 << 64))
        rolled += found[k : k + len(rolled)] * factor
    rolled = words.mix(rolled)
    sets = []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if end - begin >= size:
            own = np.sort(rolled[begin : end - size + 1])
            new = np.empty(len(own), dtype=bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            sets.append(own[new])
        elif end > begin:
            short = np.array([end - begin], dtype=np.uint64)
            for k in range(begin, end):
                short = words.mix(short * np.uint64(_STEP) + found[k : k + 1])
            sets.append(short)
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), begins


def _per_set(values: np.ndarray, begins: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``how`` over each set's values; 0 for an empty set."""
    out = np.zeros(len(begins) - 1, dtype=np.uint64)
    full = begins[:-1] < begins[1:]
    if full.any():
        out[full] = how.reduceat(values, begins[:-1][full])
    return out


def _seeded(flat: np.ndarray, seed: int) -> np.ndarray:
    return words.mix(flat ^ np.uint64(seed * _STEP % (1 << 64)))


def set_ids(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return _per_set(_seeded(flat, 1), begins, np.add).view(np.int64)


def bitmap(own: np.ndarray) -> bytes:
    """Per bit, whether an odd number of shingles fall on it; one or two bits a shingle."""
    bits = max(64, 1 << int(len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


PROFILE_SCHEMA = (
    "doc_id bigint, doc_print bigint, set_id bigint, check bigint, n int, keys array<bigint>, "
    "bits binary, bin int, bins binary"
)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document; at the end of a task, rows of its part of the sketch."""
    width = 1 << SKETCH_BITS
    sketch = np.zeros(width, dtype=np.int64)
    for batch, raw, offsets in words.chunks(batches, "text"):
        flat, begins = shingle_sets(raw, offsets)
        sketch += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=width)
        keys = np.stack(
            [_per_set(_seeded(flat, 3 + k), begins, np.minimum) for k in range(KEYS)], axis=1
        ).view(np.int64)
        ids = set_ids(flat, begins)
        n = np.diff(begins)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "doc_print": batch.column("doc_print"),
                "set_id": pa.array(ids),
                "check": pa.array(_per_set(_seeded(flat, 2), begins, np.add).view(np.int64)),
                "n": pa.array(n.astype(np.int32)),
                "keys": pa.array(keys.tolist(), pa.list_(pa.int64())),
                "bits": pa.array(
                    [bitmap(flat[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)],
                    pa.binary(),
                ),
                "bin": pa.nulls(len(n), pa.int32()),
                "bins": pa.nulls(len(n), pa.binary()),
            }
        )
    rows = [sketch[k : k + _SKETCH_ROW] for k in range(0, width, _SKETCH_ROW)]
    nothing = {
        name: pa.nulls(len(rows), kind)
        for name, kind in (
            ("doc_id", pa.int64()),
            ("doc_print", pa.int64()),
            ("set_id", pa.int64()),
            ("check", pa.int64()),
            ("n", pa.int32()),
            ("keys", pa.list_(pa.int64())),
            ("bits", pa.binary()),
        )
    }
    yield pa.RecordBatch.from_pydict(
        nothing
        | {
            "bin": pa.array(range(len(rows)), pa.int32()),
            "bins": pa.array([r.astype(np.uint64).tobytes() for r in rows], pa.binary()),
        }
    )


def _add_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each bin, which come one after the other."""
    at, total = None, np.zeros(_SKETCH_ROW, dtype=np.uint64)
    out: list[tuple[int, bytes]] = []
    for batch in batches:
        for number, row in zip(
            batch.column("bin").to_pylist(), batch.column("bins").to_pylist(), strict=True
        ):
            if number != at:
                if at is not None:
                    out.append((at, total.tobytes()))
                at, total = number, np.zeros(_SKETCH_ROW, dtype=np.uint64)
            total = total + np.frombuffer(row, dtype=np.uint64)
    if at is not None:
        out.append((at, total.tobytes()))
    yield pa.RecordBatch.from_pydict(
        {
            "bin": pa.array([number for number, _ in out], pa.int32()),
            "bins": pa.array([row for _, row in out], pa.binary()),
        }
    )


def _sketch(profiles: DataFrame) -> np.ndarray:
    """Shingle frequencies by the first bits of their hashes; of fixed size."""
    rows = profiles.where("bin IS NOT NULL").select("bin", "bins")
    rows = rows.repartition("bin").sortWithinPartitions("bin")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint64)
    for row in rows.mapInArrow(_add_bins, "bin int, bins binary").collect():
        own = np.frombuffer(row["bins"], dtype=np.uint64)
        out[row["bin"] * _SKETCH_ROW : (row["bin"] + 1) * _SKETCH_ROW] = own
    return np.minimum(out, np.uint64(0xFFFFFFFF))


def _firsts(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``token, set_id``: the first shingles of each set in the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.uint32))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, raw, offsets in words.chunks(batches, "text"):
            flat, begins = shingle_sets(raw, offsets)
            ids = set_ids(flat, begins)
            places = (flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            order = (sent.value[places].astype(np.uint64) << np.uint64(32)) | (
                words.mix(flat) >> np.uint64(32)
            )
            tokens, owners = [], []
            for row, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                if a == b or int(ids[row]) in seen:
                    continue
                seen.add(int(ids[row]))
                count = b - a - least_overlap(b - a) + 1
                first = np.argsort(order[a:b], kind="stable")[:count]
                tokens.append(flat[a:b][first])
                owners.append(np.full(count, ids[row]))
            if tokens:
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": pa.array(np.concatenate(tokens).view(np.int64)),
                        "set_id": pa.array(np.concatenate(owners)),
                    }
                )

    return docs.select("text").mapInArrow(emit, "token bigint, set_id bigint")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and set, each once, those whose token has two sets."""
    last = (np.empty(0, np.int64), np.empty(0, np.int64))
    before = None  # the token of the row ahead of the one held back

    def passed(tokens, sets, follows, final):
        same = tokens[1:] == tokens[:-1]
        keep = np.zeros(len(tokens), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= follows
        if not final:
            keep[-1] = False
        return pa.RecordBatch.from_pydict(
            {"token": pa.array(tokens[keep]), "set_id": pa.array(sets[keep])}
        )

    for batch in batches:
        tokens = np.concatenate([last[0], batch.column("token").to_numpy(zero_copy_only=False)])
        sets = np.concatenate([last[1], batch.column("set_id").to_numpy(zero_copy_only=False)])
        if not len(tokens):
            continue
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
        tokens, sets = tokens[new], sets[new]
        yield passed(tokens, sets, before is not None and before == tokens[0], False)
        before = tokens[-2] if len(tokens) > 1 else before
        last = (tokens[-1:], sets[-1:])
    if len(last[0]):
        yield passed(*last, before is not None and before == last[0][0], True)


def _near(own: np.ndarray, own_n: int, others: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether bitmaps leave it open that two sets link."""
    return _within(np.bitwise_count(others ^ own).sum(axis=1, dtype=np.int64), n + own_n)


def _within(apart: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of ``both`` shingles together can link if they differ in ``apart``."""
    return apart <= both - 2 * (-(-PERCENT * both // (100 + PERCENT)))


def candidate_edges(
    ids: np.ndarray, n: np.ndarray, bits: list[bytes], labels: np.ndarray
) -> list[tuple[int, int]]:
    """Edges that connect all sets which the bitmaps leave open, bar those labelled alike."""
    order = np.argsort(n, kind="stable")
    ids, n, labels = ids[order], n[order].astype(np.int64), labels[order].copy()
    wide = np.array([len(bits[k]) // 8 for k in order])
    maps: dict[int, tuple[int, np.ndarray]] = {}
    for width in np.unique(wide):
        rows = np.flatnonzero(wide == width)
        joined = b"".join(bits[order[k]] for k in rows)
        maps[int(width)] = (int(rows[0]), np.frombuffer(joined, np.uint64).reshape(len(rows), -1))
    folded = {
        width // 2: (first, m[:, : width // 2] ^ m[:, width // 2 :])
        for width, (first, m) in maps.items()
        if width > 1
    }
    edges = []
    for k in range(len(ids) - 1):
        stop = int(np.searchsorted(n, 100 * n[k] // PERCENT, side="right"))
        if (labels[k + 1 : stop] == labels[k]).all():
            continue
        width = int(wide[k])
        for part in (maps.get(width), folded.get(width)):
            if part is None:
                continue
            first, m = part
            low, high = max(first, k + 1), min(stop, first + len(m))
            if low >= high:
                continue
            open_ = low + np.flatnonzero(labels[low:high] != labels[k])
            if not len(open_):
                continue
            own_first, own_map = maps[width]
            hit = open_[_near(own_map[k - own_first], int(n[k]), m[open_ - first], n[open_])]
            for other in hit:
                if labels[other] != labels[k]:
                    edges.append((int(ids[k]), int(ids[other])))
                    labels[labels == labels[other]] = labels[k]
    return edges


def _open_pairs(
    left: np.ndarray, right: np.ndarray, n: np.ndarray, words_: np.ndarray, at: np.ndarray
) -> np.ndarray:
    """Which pairs of rows, the smaller set left, their bitmaps leave open.

    Row ``k`` has the words ``at[k]`` to ``at[k + 1]``.
    """
    wide = np.diff(at)
    out = np.zeros(len(left), dtype=bool)
    for width in np.unique(wide[left]).tolist():
        step = max(1, PAIR_WORDS // width)
        for times in (1, 2):
            own = np.flatnonzero((wide[left] == width) & (wide[right] == times * width))
            for begin in range(0, len(own), step):
                part = own[begin : begin + step]
                a, b = left[part], right[part]
                span = np.arange(width)
                apart = words_[at[a][:, None] + span] ^ words_[at[b][:, None] + span]
                if times == 2:
                    apart ^= words_[at[b][:, None] + width + span]
                out[part] = _within(np.bitwise_count(apart).sum(axis=1, dtype=np.int64), n[a] + n[b])
    return out


def short_edges(
    lists: np.ndarray, ids: np.ndarray, n: np.ndarray, bits: pa.Array, labels: np.ndarray
) -> list[tuple[int, int]]:
    """``candidate_edges`` of many short lists at once; ``lists`` numbers each row's, ascending."""
    order = np.lexsort((n, lists))
    lists, ids, n, labels = lists[order], ids[order], n[order].astype(np.int64), labels[order]
    raw, offsets = words.text_bytes(bits.take(pa.array(order)))
    words_, at = np.frombuffer(raw.tobytes(), np.uint64), offsets // 8
    lefts, rights = [], []
    near = np.arange(len(lists))
    for apart in range(1, len(lists)):
        near = near[near + apart < len(lists)]
        near = near[lists[near] == lists[near + apart]]
        if not len(near):
            break
        other = near + apart
        wanted = (labels[near] != labels[other]) & (n[other] <= 100 * n[near] // PERCENT)
        left, right = near[wanted], other[wanted]
        open_ = _open_pairs(left, right, n, words_, at)
        lefts.append(left[open_])
        rights.append(right[open_])
    if not lefts:
        return []
    left, right = np.concatenate(lefts), np.concatenate(rights)
    edges: list[tuple[int, int]] = []
    names: dict[tuple[int, int], tuple[int, int]] = {}

    def name(row: int) -> tuple[int, int]:
        own = int(lists[row]), int(labels[row])
        while own in names:
            own = names[own]
        return own

    for k in np.lexsort((right, left)).tolist():
        a, b = int(left[k]), int(right[k])
        one, two = name(a), name(b)
        if one != two:
            names[two] = one
            edges.append((int(ids[a]), int(ids[b])))
    return edges


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "a": pa.array([a for a, _ in edges], pa.int64()),
            "b": pa.array([b for _, b in edges], pa.int64()),
        }
    )


def _whole_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal keys, of rows sorted by these, and where each begins."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        new = np.zeros(rows.num_rows, dtype=bool)
        for key in keys:
            own = rows.column(key).to_numpy()
            new[1:] |= own[1:] != own[:-1]
        cuts = np.flatnonzero(new)
        last = int(cuts[-1]) if len(cuts) else 0
        held = rows.slice(last)
        if last:
            yield rows.slice(0, last), np.concatenate([[0], cuts])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _list_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for rows, begins in _whole_runs(batches, ["token", "i", "j"]):
        ids, n, labels = (rows.column(name).to_numpy() for name in ("set_id", "n", "label"))
        bits = rows.column("bits").combine_chunks()
        sizes = np.diff(begins)
        lists = np.repeat(np.arange(len(sizes)), sizes)
        short = np.flatnonzero(((sizes > 1) & (sizes <= SHORT_LIST))[lists])
        if len(short):
            out += short_edges(lists[short], ids[short], n[short], bits.take(pa.array(short)), labels[short])
        for k in np.flatnonzero(sizes > SHORT_LIST).tolist():
            a, b = int(begins[k]), int(begins[k + 1])
            out += candidate_edges(ids[a:b], n[a:b], bits.slice(a, b - a).to_pylist(), labels[a:b])
        if len(out) >= 10_000:
            yield _edge_batch(list(dict.fromkeys(out)))
            out = []
    yield _edge_batch(list(dict.fromkeys(out)))


def _candidates(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: edges over the lists ``token, set_id, label`` of ``sets``.

    Of lists with the same sets one is kept. A list longer than ``LIST_ROWS`` is
    cut into chunks by hash, and every pair of chunks is a list, so each pair of
    sets still meets. Bitmaps join last, so they are shuffled once.
    """
    same = lists.groupBy("token").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64("set_id")).alias("one"),
        F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("two"),
    )
    kept = same.where("rows > 1").groupBy("rows", "one", "two").agg(F.min("token").alias("token"))
    kept = kept.select("token", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("c"))
    cut = _paired(lists.join(kept, "token"), F.xxhash64("set_id"))
    cut = cut.join(sets.select("set_id", "n", "bits"), "set_id")
    cut = cut.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "set_id")
    return cut.mapInArrow(_list_edges, "a bigint, b bigint").distinct()


def _paired(rows: DataFrame, hashed) -> DataFrame:
    """Each row once for every pair ``i <= j`` of the ``c`` chunks that has its own chunk."""
    own = F.pmod(hashed, F.col("c")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    rows = rows.withColumn("own", own).withColumn("other", others)
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.drop("own", "other", "c")


class Trie:
    """Sets of ranks as a radix trie over their sorted order.

    A node covers the sets ``low`` to ``high`` and spells the ranks from depth
    ``top`` to ``bottom`` of any of them.
    """

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        tokens, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
        ranks = np.split(rank[where], np.cumsum([len(s) for s in sets])[:-1])
        ranks = [np.sort(own) for own in ranks]
        self.order = sorted(range(len(sets)), key=lambda k: ranks[k].astype(">u4").tobytes())
        self.sets = [ranks[k] for k in self.order]
        self.universe = len(tokens)
        self.sizes = np.array([len(own) for own in self.sets])
        same = [0]
        for one, two in zip(self.sets[:-1], self.sets[1:], strict=True):
            short = min(len(one), len(two))
            apart = np.flatnonzero(one[:short] != two[:short])
            same.append(int(apart[0]) if len(apart) else short)
        self._build(np.array(same))

    def _build(self, same: np.ndarray) -> None:
        """Nodes in depth-first order, each with the number of the one after its subtree."""
        nodes: list[list[int]] = []
        todo = [(0, len(self.sets), 0, -1)]
        while todo:
            low, high, top, parent = todo.pop()
            inner = same[low + 1 : high]
            bottom = int(inner.min()) if high - low > 1 else len(self.sets[low])
            number = len(nodes)
            own = self.sizes[low:high]
            nodes.append([low, high, top, bottom, parent, int(own.min()), int(own.max()), 0])
            if high - low > 1:
                cuts = [low, *(low + 1 + np.flatnonzero(inner == bottom)).tolist(), high]
                for a, b in reversed(list(zip(cuts[:-1], cuts[1:], strict=True))):
                    todo.append((a, b, bottom, number))
        after = [number + 1 for number in range(len(nodes))]
        for number in range(len(nodes) - 1, 0, -1):
            parent = nodes[number][4]
            after[parent] = max(after[parent], after[number])
        for node, end in zip(nodes, after, strict=True):
            node[7] = end
        self.nodes = nodes

    def links(self, percent: int = PERCENT) -> list[tuple[int, int]]:
        """Links that connect all sets which links connect; numbers are those given in."""
        labels = np.arange(len(self.sets))
        mark = np.zeros(self.universe, dtype=bool)
        overlap = [0] * len(self.nodes)
        out = []
        for probe, own in enumerate(self.sets):
            if (labels[probe + 1 :] == labels[probe]).all():
                continue
            mark[own] = True
            n = len(own)
            least, most = least_overlap(n, percent), 100 * n // percent
            number = 0
            while number < len(self.nodes):
                low, high, top, bottom, parent, small, large, after = self.nodes[number]
                if high <= probe + 1 or small > most or large < least:
                    number = after
                    continue
                if (labels[max(low, probe + 1) : high] == labels[probe]).all():
                    number = after
                    continue
                path = self.sets[low][top:bottom]
                shared = overlap[parent] if parent >= 0 else 0
                shared += int(np.count_nonzero(mark[path]))
                overlap[number] = shared
                left = n - int(np.searchsorted(own, path[-1], side="right")) if bottom > top else n
                fewest, longest = max(small, least), min(large, most)
                if (
                    (100 + percent) * (shared + left) < percent * (n + fewest)
                    or (100 + percent) * (shared + longest - bottom) < percent * (n + longest)
                ):
                    number = after
                    continue
                if high - low == 1:
                    if 100 * shared >= percent * (n + large - shared):
                        out.append((self.order[probe], self.order[low]))
                        labels[labels == labels[low]] = labels[probe]
                number += 1
            mark[own] = False
        return out


def _block_links(key: tuple, block: pa.Table) -> pa.Table:
    """The links within one block or pair of chunks."""
    own: dict[int, np.ndarray] = {}
    for name, tokens in zip(
        block.column("set_id").to_pylist(), block.column("tokens").to_pylist(), strict=True
    ):
        own.setdefault(name, np.frombuffer(tokens, dtype=np.uint64))
    ids = sorted(own)
    links = Trie([own[name] for name in ids]).links() if len(ids) > 1 else []
    return pa.Table.from_batches([_edge_batch([(ids[a], ids[b]) for a, b in links])])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, offsets in words.chunks(batches, "text"):
        flat, begins = shingle_sets(raw, offsets)
        own = [flat[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "block": batch.column("block"),
                "i": batch.column("i"),
                "j": batch.column("j"),
                "set_id": pa.array(set_ids(flat, begins)),
                "tokens": pa.array(own, pa.binary()),
            }
        )


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The documents with their sets, and the class of every set that links to another.

    The first has ``doc_id, doc_print, set_id, n``, a row for each of ``docs``; the second
    ``set_id, class``. ``doc_print`` is a hash of the text.
    """
    docs = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("doc_print"),
        F.col(text).alias("text"),
    )
    profiles = written(docs.mapInArrow(_profiles, PROFILE_SCHEMA), "profiles")
    members = profiles.where("bin IS NULL")
    sets = members.where("n > 0").groupBy("set_id").agg(
        F.min("check").alias("check"),
        F.max("check").alias("other"),
        F.min("n").alias("n"),
        F.min(F.struct("doc_id", "doc_print")).alias("rep"),
        F.first("keys").alias("keys"),
        F.first("bits").alias("bits"),
    )
    clash = F.raise_error(F.lit("two different sets share a hash"))
    sets = written(
        sets.withColumn("n", F.when(F.col("check") == F.col("other"), F.col("n")).otherwise(clash.cast("int"))),
        "sets",
    )
    early = sets.select(F.posexplode("keys").alias("k", "key"), "set_id").select(
        F.xxhash64("k", "key").alias("token"), "set_id", F.col("set_id").alias("label")
    )
    clusters = components(_candidates(early, sets)).select(
        F.col("node").alias("set_id"), F.col("component").alias("label")
    )

    rows = _firsts(docs, _sketch(profiles)).repartition("token")
    rows = rows.sortWithinPartitions("token", "set_id")
    shared = rows.mapInArrow(_shared, "token bigint, set_id bigint")
    labelled = shared.join(clusters, "set_id", "left").withColumn(
        "label", F.coalesce("label", "set_id")
    )
    of_token = Window.partitionBy("token")
    mixed = labelled.withColumn("low", F.min("label").over(of_token))
    mixed = mixed.withColumn("high", F.max("label").over(of_token))
    mixed = written(mixed.where("low <> high").select("token", "set_id", "label"), "lists")
    late = _candidates(mixed, sets)
    late = late.join(clusters.toDF("a", "la"), "a", "left").join(
        clusters.toDF("b", "lb"), "b", "left"
    )
    late = late.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(late)

    blocks = sets.select("set_id", "n", "rep").join(clusters, "set_id", "left")
    blocks = blocks.withColumn("label", F.coalesce("label", "set_id"))
    blocks = blocks.join(merged.toDF("label", "block"), "label", "left")
    blocks = blocks.withColumn("block", F.coalesce("block", "label"))
    sizes = blocks.groupBy("block").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")
    ).where("sets > 1")
    blocks = blocks.join(sizes, "block").withColumn(
        "c", F.ceil(F.col("shingles") / CHUNK_SHINGLES).cast("int")
    )
    reps = blocks.select(
        F.col("rep.doc_id").alias("rep_id"), F.col("rep.doc_print").alias("rep_print"),
        "block", "set_id", "c",
    )
    same = docs["doc_id"].eqNullSafe(reps["rep_id"]) & (docs["doc_print"] == reps["rep_print"])
    of_block = _paired(docs.join(reps, same).drop("rep_id", "rep_print"), F.xxhash64("set_id"))
    of_block = of_block.select("block", "i", "j", "text").mapInArrow(
        _tokens, "block bigint, i int, j int, set_id bigint, tokens binary"
    )
    links = of_block.groupBy("block", "i", "j").applyInArrow(_block_links, "a bigint, b bigint")
    found = components(links).select(
        F.col("node").alias("set_id"), F.col("component").alias("class")
    )
    return members.select("doc_id", "doc_print", "set_id", "n"), found


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``."""
    members, found = classes(docs, doc_id, text)
    rows = members.join(found, "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))
    least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "class", "left")
    return rows.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest doc_id, then of the least text hash.

    Rows without words all stay.
    """
    members, found = classes(docs)
    rows = members.where("n > 0").join(found, "set_id", "left")
    rows = rows.withColumn("class", F.coalesce("class", "set_id"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_print")
    kept = rows.groupBy("class").agg(
        F.min(place).alias("kept"), F.count(F.lit(1)).alias("rows")
    )
    id_, print_, count = (free_name(docs, n) for n in ("_kept_id", "_kept_print", "_rows"))
    kept = kept.select(
        F.col("kept.doc_id").alias(id_),
        F.col("kept.doc_print").alias(print_),
        F.col("rows").alias(count),
    )
    empty = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    full = docs.where(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    same = full["doc_id"].eqNullSafe(kept[id_]) & (F.xxhash64(full["text"]) == kept[print_])
    full = full.join(kept, same)
    alone = full.where(F.col(count) == 1).select(docs.columns)
    # Only where a class has several rows can the kept one be there twice.
    more = full.where(F.col(count) > 1).dropDuplicates([id_, print_]).select(docs.columns)
    return alone.unionByName(more).unionByName(empty)
