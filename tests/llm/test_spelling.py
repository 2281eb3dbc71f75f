import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contexture.llm import spelling
from tests.llm.helpers import SCHEMA, awkward, frame, lower


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_words(rows):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            found[run] += 1
    return {word: n for word, n in found.items() if len(word) >= 7 and n >= 2}


LETTERS = [chr(c) for c in range(256) if re.match("[A-Za-zÀ-ÿ]", chr(c))]


def neighbours(word, words):
    """Every word that one edit makes of ``word``, by trying all edits."""
    if len(word) > 100:
        return [other for other in words if near(word, other)]
    letters = LETTERS
    tried = set()
    for at in range(len(word) + 1):
        head, tail = word[:at], word[at:]
        tried |= {head + tail[1:]} | {head + x + tail for x in letters} | {head + x + tail[1:] for x in letters}
    return [other for other in tried if other in words and other != word]


def brute(words):
    form, met = {}, {}
    for a, n in words.items():
        others = neighbours(a, words)
        met[a] = len(others)
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 10 * n else None
    out = []
    for a, n in words.items():
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n, met[a], words[form[a]] if form[a] else None))
    return sorted(out)


def mutated(seed, count):
    """Words and their neighbours: few letters, so that bigrams repeat within a word."""
    pick = random.Random(seed)
    words = {}
    for _ in range(count):
        word = "".join(pick.choices("abÀé÷", k=pick.randint(7, 11)))
        for _ in range(pick.randint(1, 4)):
            words[word] = pick.choice([2, 3, 30, 400, 5000])
            at, kind = pick.randrange(len(word)), pick.randrange(3)
            word = word[:at] + ("" if kind == 0 else pick.choice("abé")) + word[at + (kind < 2) :]
    return {word: n for word, n in words.items() if len(word) >= 7}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_brute_force(spark, seed):
    words = mutated(seed, 250)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    found = sorted(tuple(r) for r in spelling.grouped(df).collect())
    assert found == brute(words)
    assert sum(r[4] for r in found) > 100 and any(r[1] for r in found)


def test_each_pair_is_met_once(spark):
    words = mutated(3, 200)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(spelling.with_pivots(df)).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_pivots_are_the_cheapest_disjoint_bigrams_of_the_prefix(spark):
    words = sorted(w for w in mutated(4, 300) if len(w) == 9)
    counts = Counter(w[k : k + 2] for w in words for k in range(8))
    order = sorted(counts, key=lambda g: (counts[g], g))
    rank, held = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
    for place, gram in enumerate(order):
        rank[ord(gram[0]) * 256 + ord(gram[1])] = place
        held[ord(gram[0]) * 256 + ord(gram[1])] = counts[gram]
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), 9)
    reach, first, second, heads, tails = spelling.pivots(letters, rank, held)
    for k, word in enumerate(words):
        ranks = [order.index(word[p : p + 2]) for p in range(8)]
        third = sorted(ranks)[2]
        lower = {p for p in range(8) if ranks[p] < third}
        one = lower | {ranks.index(third)}
        two = lower | {7 - ranks[::-1].index(third)}
        assert reach[k] == third
        assert set(np.flatnonzero(heads[k])) == one and set(np.flatnonzero(tails[k])) == two
        assert first[k] in one and second[k] in two and second[k] - first[k] >= 2
        costs = [counts[word[p : p + 2]] for p in range(8)]
        assert costs[first[k]] + costs[second[k]] == min(
            costs[p] + costs[q] for p in one for q in two if q - p >= 2
        )


def documents():
    rows = awkward()
    text = " ".join(["Straßenbahn"] * 40 + ["strassenbahn", "Strasenbahn×", "strasœsenbahn"] * 2)
    rows += [(500 + k, text, None, None, None) for k in range(40)]
    return rows + [(900, "x" * 70_000 + " " + "x" * 70_000, "en", "a", 1), (None, text, None, None, 0)]


def test_words_of_awkward_documents(spark):
    rows = documents()
    found = spelling.variants(frame(spark, rows, SCHEMA))
    assert sorted(tuple(r) for r in found.collect()) == brute(brute_words(rows))


def test_extra_columns_and_clashing_names(spark):
    rows = documents()
    docs = frame(spark, rows, SCHEMA)
    for name in ("word", "n", "mark", "key", "part", "root"):
        docs = docs.withColumn(name, F.lit("x"))
    assert spelling.variants(docs).count() == len(brute_words(rows))


def test_no_words(spark):
    assert spelling.variants(frame(spark, [], SCHEMA)).collect() == []
    assert spelling.variants(frame(spark, [(1, None, "", "", 0), (2, "no, 12", "", "", 0)], SCHEMA)).collect() == []


def test_a_way_of_many_forms(spark):
    """Each word ten times as common as the one before it; the last is the root of all."""
    words = {"abcdefghij"[:k] + "z" * (18 - k): 2 * 10**k for k in range(10)}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = {r.word: r.root for r in spelling.grouped(df).collect()}
    assert found == {row[0]: row[2] for row in brute(words)}
    assert len(set(found.values())) == 1
