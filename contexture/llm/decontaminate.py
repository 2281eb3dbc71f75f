"""Benchmark decontamination through a positional inverted index.

``build_index`` stores the postings of all training words: per segment of
consecutive documents the distinct words (as 64-bit hashes), how often each
occurs, and its positions, ordered by word and position. The index is split by
document, so a phrase is looked up where all its words' postings lie and
postings are never shuffled.

``windows`` cuts the items into phrases, as a table of distinct ones with numbers and
a table of whose they are. Phrases go to the tasks in blocks of counted size; items
stay a table and are joined with what was found.

``hits`` takes each phrase's rarest word in the segment, and cuts its list with those
of the phrase's other words, each shifted by its offset, rarest first. What is left
are the exact occurrences. With ``span`` it finds proximity matches: for every document
word that is one of the phrase's, the shortest stretch from it that holds all words of
the phrase in any order, if that is not longer than ``span`` words. A word that a phrase
has twice counts once there, and so an exact occurrence is a match too.

Defined results: null and empty texts have no words and no hits; a null doc_id
is a document like others; a repeated row is a document of its own; items
without words are never found; a repeated item counts once by its id; a null
item_id is kept out of the list of items but hits words. Columns other than the
two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contexture.llm import words
from contexture.llm.tables import written

WINDOW = 10
SEGMENT_WORDS = 1 << 20
SPAN = 20
#: Eight bytes a word of each phrase; a task also holds them as places in a vocabulary.
PHRASE_BLOCK_BYTES = 32 << 20
_BATCH_WINDOWS = 1 << 13

INDEX_SCHEMA = (
    "segment string, doc_ids array<bigint>, doc_prints array<bigint>, "
    "doc_words array<bigint>, terms binary, counts binary, positions binary"
)
HITS_SCHEMA = (
    "segment string, nth int, doc_id bigint, doc_print bigint, n_words bigint, "
    "spans array<struct<first:bigint,last:bigint,nr:bigint>>"
)


@dataclass
class Postings:
    """The index of one segment."""

    terms: np.ndarray
    begins: np.ndarray
    positions: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, terms: bytes, counts: bytes, positions: bytes, doc_words: list) -> Postings:
        sizes = np.frombuffer(counts, dtype=np.uint32)
        return cls(
            np.frombuffer(terms, dtype=np.uint64),
            np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]),
            np.frombuffer(positions, dtype=np.uint32),
            np.concatenate([[0], np.cumsum(doc_words, dtype=np.int64)]),
        )

    def find(self, vocabulary: np.ndarray) -> np.ndarray:
        """Where each word stands among the terms; -1 where it does not."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1, dtype=np.int64)
        at = np.searchsorted(self.terms, vocabulary)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == vocabulary, at, -1)

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, 0, self.begins[at + 1] - self.begins[at])

    def list_of(self, at: int) -> np.ndarray:
        return self.positions[self.begins[at] : self.begins[at + 1]].astype(np.int64)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, position, side="right") - 1

    def phrase(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """First positions of the exact phrase whose words stand at ``at``."""
        order = np.argsort(sizes, kind="stable")
        starts = self.list_of(at[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                return starts
            own = self.positions[self.begins[at[k]] : self.begins[at[k] + 1]]
            # The shifted list, cut to where it can meet: compare in its own type.
            wanted = starts + k
            spot = np.searchsorted(own, wanted.astype(np.uint32))
            spot[spot == len(own)] = 0
            starts = starts[own[spot] == wanted]
        keep = starts >= 0
        keep &= self.doc_of(starts) == self.doc_of(starts + len(at) - 1)
        return starts[keep]

    def near(self, at: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last positions of the stretches that hold all words in any order."""
        at, once = np.unique(at, return_index=True)
        order = np.argsort(sizes[once], kind="stable")
        lists = [self.list_of(at[k]) for k in order]
        # Places of the rarest word with every other within reach, in its document.
        anchors = lists[0]
        doc = self.doc_of(anchors)
        low = np.maximum(anchors - span + 1, self.firsts[doc])
        high = np.minimum(anchors + span, self.firsts[doc + 1])
        for own in lists[1:]:
            if not len(anchors):
                break
            keep = np.searchsorted(own, low) < np.searchsorted(own, high)
            anchors, low, high = anchors[keep], low[keep], high[keep]
        starts = (anchors[:, None] - np.arange(span)).ravel()
        starts = np.unique(starts[starts >= np.repeat(low, span)])
        ends = self.firsts[self.doc_of(starts) + 1]
        last, begins = starts.copy(), np.zeros(len(starts), dtype=bool)
        for own in lists:
            spot = np.searchsorted(own, starts)
            there = spot < len(own)
            found = np.where(there, own[np.where(there, spot, 0)], ends)
            begins |= found == starts
            last = np.maximum(last, found)
        keep = begins & (last < ends) & (last - starts < span)
        return starts[keep], last[keep]


def build_index(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """The stored index, one row per segment of about ``segment_words`` words.

    A document is never split, so a segment is larger where one document is.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, prints, sizes, lists = [], [], [], []
        for batch, raw, offsets in words.chunks(batches, "text"):
            starts, ends, first = words.spans(raw, offsets, words.ALNUM)
            found = words.hashes(raw, starts, ends)
            row = 0
            while row < batch.num_rows:
                room = max(0, segment_words - sum(map(len, lists)))
                stop = int(np.searchsorted(first, first[row] + room, side="right")) - 1
                stop = min(max(stop, row + (not ids)), batch.num_rows)
                ids += batch.column("doc_id")[row:stop].to_pylist()
                prints += batch.column("doc_print")[row:stop].to_pylist()
                sizes += np.diff(first[row : stop + 1]).tolist()
                lists.append(found[first[row] : first[stop]])
                if stop < batch.num_rows:
                    yield _segment(f"{part}-{made}", ids, prints, sizes, lists)
                    made += 1
                    ids, prints, sizes, lists = [], [], [], []
                row = stop
        if ids:
            yield _segment(f"{part}-{made}", ids, prints, sizes, lists)

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("doc_print"),
        F.col(text).alias("text"),
    )
    return written(rows.mapInArrow(segments, INDEX_SCHEMA), "postings")


def _segment(name: str, ids: list, prints: list, sizes: list, lists: list) -> pa.RecordBatch:
    found = np.concatenate(lists)
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)])
    counts = np.diff(np.append(new, len(ranked)))
    return pa.RecordBatch.from_pydict(
        {
            "segment": pa.array([name], pa.string()),
            "doc_ids": pa.array([ids], pa.list_(pa.int64())),
            "doc_prints": pa.array([prints], pa.list_(pa.int64())),
            "doc_words": pa.array([sizes], pa.list_(pa.int64())),
            "terms": pa.array([ranked[new].tobytes()], pa.binary()),
            "counts": pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
            "positions": pa.array([order.astype(np.uint32).tobytes()], pa.binary()),
        }
    )


@dataclass
class Windows:
    """Phrases ``nr, phrase`` (its words' hashes), and whose they are: ``nr, item``."""

    phrases: DataFrame
    owners: DataFrame


def windows(
    items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW
) -> Windows:
    """The windows of all items, as written tables.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in words.chunks(batches, "text"):
            starts, ends, first = words.spans(raw, offsets, words.ALNUM)
            found = words.hashes(raw, starts, ends)
            sizes = np.diff(first)
            counts = np.where(sizes > 0, np.maximum(sizes - window, 0) + 1, 0)
            row = np.repeat(np.arange(len(sizes)), counts)
            begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            length = np.minimum(sizes[row], window)
            for k in range(0, len(row), _BATCH_WINDOWS):
                own = slice(k, k + _BATCH_WINDOWS)
                upto = np.concatenate([[0], np.cumsum(length[own])])
                at = np.repeat(begin[own] - upto[:-1], length[own]) + np.arange(upto[-1])
                buffers = [pa.py_buffer((upto * 8).astype(np.int32).tobytes()), pa.py_buffer(found[at].tobytes())]
                phrase = pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, *buffers])
                item = batch.column("item").take(pa.array(row[own]))
                yield pa.RecordBatch.from_arrays([phrase, item], names=["phrase", "item"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    rows = rows.where("text IS NOT NULL").distinct()
    listed = written(rows.mapInArrow(cut, "phrase binary, item string").distinct(), "windows")
    phrases = listed.select("phrase").distinct()
    phrases = phrases.select(F.monotonically_increasing_id().alias("nr"), "phrase")
    phrases = written(phrases, "phrases")
    owners = listed.where("item IS NOT NULL").join(phrases, "phrase").select("nr", "item")
    return Windows(phrases, owners)


@dataclass
class Phrases:
    """A block of phrases as places in a vocabulary."""

    vocabulary: np.ndarray
    terms: np.ndarray
    begins: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, block: pa.Table) -> Phrases:
        raw, offsets = words.text_bytes(block.column("phrase"))
        vocabulary, terms = np.unique(np.frombuffer(raw.tobytes(), np.uint64), return_inverse=True)
        numbers = block.column("nr").to_numpy()
        return cls(vocabulary, terms.astype(np.int32), offsets // 8, numbers)


def _segment_hits(postings: Postings, phrases: Phrases, span: int | None) -> np.ndarray:
    """Document of the segment, first and last word, and phrase of each hit, as columns."""
    found = [np.empty((4, 0), dtype=np.int64)]
    if len(phrases.terms):
        at = postings.find(phrases.vocabulary)
        sizes = postings.sizes(at)
        least = np.minimum.reduceat(sizes[phrases.terms], phrases.begins[:-1])
        for p in np.flatnonzero(least > 0):
            own = phrases.terms[phrases.begins[p] : phrases.begins[p + 1]]
            if span is None:
                starts = postings.phrase(at[own], sizes[own])
                ends = starts + len(own) - 1
            else:
                starts, ends = postings.near(at[own], sizes[own], span)
            if len(starts):
                doc = postings.doc_of(starts)
                number = np.full(len(doc), phrases.numbers[p])
                first = postings.firsts[doc]
                found.append(np.stack([doc, starts - first, ends - first, number]))
    return np.concatenate(found, axis=1)


def _blocks(phrases: DataFrame, limit: int) -> Iterator[pa.Table]:
    """The phrases in blocks of about ``limit`` bytes, by their hash; they are distinct."""
    size = phrases.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = -(-size // limit) or 1
    for block in range(blocks):
        yield phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).toArrow()


def hits(
    index: DataFrame,
    wanted: Windows,
    span: int | None = None,
    block_bytes: int = PHRASE_BLOCK_BYTES,
) -> DataFrame:
    """Every document of the index, with the places of the phrases and their numbers.

    Places are exact occurrences or, with ``span``, proximity matches. What is sent
    to the tasks at once is bounded by ``block_bytes`` however many items there are.
    """
    spark = index.sparkSession
    parts = []
    for block in _blocks(wanted.phrases, block_bytes):
        sent = spark.sparkContext.broadcast(Phrases.of(block))

        def search(
            batches: Iterator[pa.RecordBatch], sent=sent
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield _search(batch.slice(row, 1).to_pylist()[0], sent.value, span)

        parts.append(index.mapInArrow(search, HITS_SCHEMA))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) == 1:
        return found
    return found.groupBy("segment", "nth", "doc_id", "doc_print", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans")
    )


def _search(row: dict, phrases: Phrases, span: int | None) -> pa.RecordBatch:
    postings = Postings.of(row["terms"], row["counts"], row["positions"], row["doc_words"])
    found = _segment_hits(postings, phrases, span)
    found = found[:, np.argsort(found[0], kind="stable")]
    count = len(row["doc_ids"])
    upto = np.searchsorted(found[0], np.arange(count + 1)).astype(np.int32)
    names = ["first", "last", "nr"]
    places = pa.StructArray.from_arrays([pa.array(part) for part in found[1:]], names=names)
    return pa.RecordBatch.from_pydict(
        {
            "segment": pa.array([row["segment"]] * count, pa.string()),
            "nth": pa.array(range(count), pa.int32()),
            "doc_id": pa.array(row["doc_ids"], pa.int64()),
            "doc_print": pa.array(row["doc_prints"], pa.int64()),
            "n_words": pa.array(row["doc_words"], pa.int64()),
            "spans": pa.ListArray.from_arrays(pa.array(upto), places),
        }
    )


def matches(found: DataFrame, wanted: Windows) -> DataFrame:
    """A row for each place and item: ``segment, nth`` (which document), ``doc_id, item, first, last``."""
    rows = found.selectExpr("segment", "nth", "doc_id", "inline(spans)")
    return rows.join(wanted.owners, "nr").drop("nr")


def proximity(docs: DataFrame, items: DataFrame, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """``doc_id, item_id, n_places``: documents that hold all words of a window close together.

    ``n_places`` counts the document words from which a match begins. A repeated
    document has its rows again; a null item_id has none.
    """
    wanted = windows(items, window=window)
    found = hits(build_index(docs), wanted, span).where("size(spans) > 0")
    rows = matches(found, wanted).select("segment", "nth", "doc_id", "item", "first").distinct()
    rows = rows.groupBy("segment", "nth", "doc_id", F.col("item").alias("item_id"))
    return rows.agg(F.count("*").alias("n_places")).drop("segment", "nth")


def summary(found: DataFrame, wanted: Windows) -> DataFrame:
    """Per document: words, words hit, items found and their digest."""
    start = "named_struct('hit', 0L, 'upto', -1L)"
    merged = (
        f"aggregate(array_sort(spans), {start}, (a, s) -> named_struct("
        "'hit', a.hit + greatest(0L, s.last - greatest(s.first, a.upto + 1) + 1), "
        "'upto', greatest(a.upto, s.last)), a -> a.hit)"
    )
    numbers = "array_distinct(transform(spans, s -> s.nr))"
    found = found.select(
        "segment", "nth", "doc_id", "doc_print", "n_words", F.expr(merged).alias("n_hit"), F.expr(numbers).alias("nrs")
    )
    found = written(found, "hits")
    rows = found.select("segment", "nth", F.explode("nrs").alias("nr"))
    rows = rows.join(wanted.owners, "nr").select("segment", "nth", "item").distinct()
    items = rows.groupBy("segment", "nth").agg(F.array_sort(F.collect_list("item")).alias("items"))
    nothing = F.array().cast("array<string>")
    return (
        found.join(items, ["segment", "nth"], "left")
        .withColumn("items", F.coalesce("items", nothing))
        .select(
            "doc_id",
            "doc_print",
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs.

    A row is told by its doc_id and a 64-bit hash of its text.
    """
    bad = (
        hits(build_index(docs), windows(items, window=window))
        .where("size(spans) > 0")
        .select(F.col("doc_id").alias("_bad_id"), F.col("doc_print").alias("_bad_print"))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (
        F.xxhash64(docs["text"]) == bad["_bad_print"]
    )
    return docs.join(bad, same, "left_anti")
