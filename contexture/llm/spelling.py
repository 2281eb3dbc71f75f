"""Spelling variants of the words of a corpus, by pivotal grams.

Two words are near if one inserted, deleted or replaced code point makes one of
the other. All bigrams of all words are ordered by the number of words that hold
them, rare ones first. A word's prefix is its three rarest bigrams, and its reach
the rank of the third; its pivots are two disjoint bigrams of the prefix with the
least total count, found by dynamic programming along the word. One edit spoils at
most one of two disjoint bigrams, so of two near words the one with the smaller
reach keeps a pivot that lies in the other's prefix: pivots are looked up among
prefixes and nowhere else.

Position limits: an edit right of a pivot moves nothing up to the pivot's end, an
edit left of it nothing from its start on. So the first pivot is looked up with
the text up to its end (edits right of it), the second with the text from its
start on (all other edits). Of the part that holds the edit one half is untouched
too, so either half is looked up along with the rest, for the three lengths the
other word may have there; what meets is verified. Where the third bigram occurs again and again, its
first place serves as a first pivot and its last as a second: an edit right of the
first place, or left of the last, leaves it the first or last of the other word
too. So a prefix has at most three places each way, however a word repeats itself.

The lookup is an equality join on hashes of these texts, whose condition holds the
verification: candidates are never rows. A text that very many words share is
split by adaptive execution, as the join lies directly on its shuffles.

Defined results: a null text has no words and a null id reads as the empty string;
case is changed for A-Z alone; equal ids and repeated rows count like others; no
words give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contexture.llm.tables import written

#: Code points of words, and the shortest word and least count that take part.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH = 7
MIN_COUNT = 2
#: How many times as common a near word must be to be a word's form.
RATIO = 10
#: Of one in so many places of a word a code point is taken away, as the places' hash says.
DAMAGE = 31

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAM_SCHEMA = (
    "word string, n bigint, reach int, first int, second int, heads array<int>, tails array<int>"
)
#: Code points of the words that a task looks at together, but for one very long word.
SLICE = 1 << 21


def places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, word``: every run of letters that is long enough, A-Z lower-cased.

    A run shorter than ``MIN_LENGTH`` can only become shorter, so it is left out.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{MIN_LENGTH},}})"), F.lit(1))
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"),
        F.explode(runs).alias("word"),
    )
    return rows.withColumn("word", F.translate("word", _UPPER, _UPPER.lower()))


def damaged(rows: DataFrame) -> DataFrame:
    """``word`` with a code point taken away where the hash of its place says so."""
    mark = F.crc32(F.concat("doc_id", F.lit(":"), "word"))
    rows = rows.withColumn("mark", mark)
    at = F.expr("CAST(mark % length(word) AS INT)")
    without = F.concat(
        F.expr("substring(word, 1, CAST(mark % length(word) AS INT))"),
        F.substring("word", at + 2, F.length("word")),
    )
    word = F.when(F.col("mark") % DAMAGE == 0, without).otherwise(F.col("word"))
    return rows.select("doc_id", word.alias("word"))


def vocabulary(rows: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the distinct words and how often each occurs."""
    rows = rows.where(F.length("word") >= min_length)
    counted = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words' places hold each bigram.

    Words are of at most 90 letters, so there are at most 8,100 bigrams, whatever
    the number of words.
    """
    grams = F.expr("explode(transform(sequence(1, length(word) - 1), k -> substring(word, k, 2)))")
    found = words.select(grams.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    return {row["gram"]: row["held"] for row in found.collect()}


def pivots(letters: np.ndarray, rank: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """For words of one length, as rows of Latin-1 codes: reach, both pivots, prefix masks.

    ``rank`` and ``held`` give order and count of a bigram by its two codes. The
    masks are the places a first and a second pivot may have. Pivots are those of
    least total count, then the leftmost: ``one`` is the least count of a first
    pivot up to each place, ``two`` that of a second with a first that ends before.
    """
    grams = letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]
    order = rank[grams]
    reach = np.partition(order, 2, axis=1)[:, 2]
    heads = order < reach[:, None]
    tails = heads.copy()
    own = np.arange(len(grams))
    third = order == reach[:, None]
    heads[own, np.argmax(third, axis=1)] = True
    tails[own, third.shape[1] - 1 - np.argmax(third[:, ::-1], axis=1)] = True
    far = np.int64(1) << 60
    cost = held[grams]
    as_first = np.where(heads, cost, far)
    one = np.minimum.accumulate(as_first, axis=1)
    two = one[:, :-2] + np.where(tails, cost, far)[:, 2:]
    second = np.argmin(two, axis=1) + 2
    upto = np.arange(grams.shape[1])[None, :] <= (second - 2)[:, None]
    first = np.argmin(np.where(upto, as_first, far), axis=1)
    return reach, first, second, heads, tails


def with_pivots(words: DataFrame) -> DataFrame:
    """``GRAM_SCHEMA``: each word with its prefix places, their reach and its pivots (from 0)."""
    counts = gram_counts(words)
    codes = {gram: ord(gram[0]) * 256 + ord(gram[1]) for gram in counts}
    rank = np.zeros(1 << 16, np.int32)
    held = np.zeros(1 << 16, np.int64)
    for place, gram in enumerate(sorted(counts, key=lambda g: (counts[g], g))):
        rank[codes[gram]] = place
        held[codes[gram]] = counts[gram]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _chosen(batch, rank, held)

    return words.select("word", "n").mapInArrow(choose, GRAM_SCHEMA)


def _chosen(batch: pa.RecordBatch, rank: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    raw = [word.encode("latin-1") for word in batch.column(0).to_pylist()]
    sizes = np.array([len(word) for word in raw])
    chosen = []
    for size in np.unique(sizes):
        step = max(1, SLICE // int(size))
        same = np.flatnonzero(sizes == size)
        for own in (same[k : k + step] for k in range(0, len(same), step)):
            letters = np.frombuffer(b"".join(raw[k] for k in own), np.uint8)
            *parts, heads, tails = pivots(letters.reshape(len(own), size), rank, held)
            rows = batch.take(pa.array(own))
            columns = [rows.column(0), rows.column(1)]
            columns += [pa.array(part, pa.int32()) for part in parts]
            chosen.append([*columns, _listed(heads), _listed(tails)])
    names = ["word", "n", "reach", "first", "second", "heads", "tails"]
    merged = [pa.concat_arrays(list(parts)) for parts in zip(*chosen, strict=True)]
    return pa.RecordBatch.from_arrays(merged, names=names)


def _listed(mask: np.ndarray) -> pa.ListArray:
    """The places of each row of ``mask``."""
    ends = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.nonzero(mask)[1], pa.int32())
    )


def _parts(before: str, size: str, side: int, own: str) -> str:
    """Hashes of both halves of an edited part of ``size`` code points after ``before``.

    ``own`` is the length of the part in the word at hand, which may be one more or
    less than ``size``: the second half is counted from its end.
    """
    half = f"({size}) div 2"
    first = f"substring(word, {before} + 1, {half})"
    second = f"substring(word, greatest({before} + {own} - ({size}) + {half}, 0) + 1, ({size}) - {half})"
    kept = "substring(word, 1, place + 2)" if side == 0 else "substring(word, place + 1)"
    return f"array(xxhash64({side}, {size}, 0, {kept}, {first}), xxhash64({side}, {size}, 1, {kept}, {second}))"


def near_pairs(chosen: DataFrame) -> DataFrame:
    """``a, b``: each pair of near words once."""
    right, left = "length(word) - place - 2", "place"
    sides = [(0, "first", "heads", "place + 2", right), (1, "second", "tails", "0", left)]

    def at(place: str, expression: str) -> str:
        return f"flatten(transform({place}, place -> {expression}))"

    looked_up = chosen.selectExpr(
        "word AS a",
        "reach AS a_reach",
        "explode(concat("
        + ", ".join(
            at(
                f"array({pivot})",
                f"flatten(transform(sequence(-1, 1), d -> {_parts(before, f'{own} + d', side, own)}))",
            )
            for side, pivot, _, before, own in sides
        )
        + ")) AS part",
    )
    indexed = chosen.selectExpr(
        "word AS b",
        "reach AS b_reach",
        "explode(concat("
        + ", ".join(
            at(places, _parts(before, own, side, own)) for side, _, places, before, own in sides
        )
        + ")) AS b_part",
    )
    meeting = [
        F.col("part") == F.col("b_part"),
        F.expr("a_reach < b_reach OR (a_reach = b_reach AND a < b)"),
        F.expr("levenshtein(a, b, 1) = 1"),
    ]
    joined = looked_up.join(indexed, reduce(lambda x, y: x & y, meeting))
    return joined.select("a", "b").distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n``: the most common near word, if common enough."""
    ends = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    ends = ends.join(words.selectExpr("word AS near", "n AS m"), "near")
    met = ends.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("near"))).alias("best"),
    )
    rows = words.select("word", "n").join(met, "word", "left")
    common = F.expr(f"-best.less >= {ratio} * n")
    return rows.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.less")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` with ``root``, the last form that following forms leads to.

    A form is ``ratio`` times as common as its word, so ways are short; every round
    doubles how far each word has followed its way.
    """
    ways = written(found.where("form IS NOT NULL").selectExpr("word", "form AS root"), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(further, "root", "left_semi").isEmpty():
            break
        ways = ways.join(further, "root", "left")
        ways = written(ways.select("word", F.coalesce("further", "root").alias("root")), "ways")
    return found.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for words of Latin letters with their counts."""
    chosen = written(with_pivots(words), "grams")
    pairs = written(near_pairs(chosen), "near")
    found = written(forms(chosen, pairs, ratio), "forms")
    columns: list[str | Column] = ["word", "form", "root", "n", "n_near", "form_n"]
    return with_roots(found).select(columns)


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs``, some of them damaged by rule, grouped with their variants."""
    words = vocabulary(damaged(places(docs, doc_id, text)))
    return grouped(written(words, "words"))
