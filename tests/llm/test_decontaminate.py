import hashlib
import random

from contexture.llm import decontaminate
from tests.llm.helpers import ALNUM, awkward, frame, lower, prose

ITEMS = [
    (0, prose(2, 20)),
    (1, "one two"),
    (2, None),
    (3, " .,"),
    (4, prose(1, 15)),
    (4, prose(1, 15)),
    (5, "never written words here at all"),
    (None, prose(3, 12)),
    (6, prose(3, 12)),
]


def brute(rows, items, window=10):
    windows = {}
    for item, text in items:
        own = ALNUM.findall(lower(text))
        for k in range(max(len(own) - window, 0) + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + window]), set()).add(item)
    lengths = {len(key) for key in windows}
    out = []
    for doc_id, text, *_ in rows:
        own, hit, found = ALNUM.findall(lower(text)), set(), set()
        for k in range(len(own)):
            for n in lengths:
                items_here = windows.get(tuple(own[k : k + n]))
                if items_here and k + n <= len(own):
                    hit.update(range(k, k + n))
                    found |= items_here
        names = sorted(str(item) for item in found if item is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


def answer(docs, items, **options):
    wanted = decontaminate.windows(items)
    found = decontaminate.hits(decontaminate.build_index(docs, segment_words=500), wanted, **options)
    return sorted((tuple(r) for r in decontaminate.summary(found, wanted).drop("doc_print").collect()), key=repr)


def brute_near(rows, items, window, span):
    out = []
    for doc_id, text, *_ in rows:
        own, places = ALNUM.findall(lower(text)), {}
        for item, said in items:
            words = ALNUM.findall(lower(said))
            for k in range(max(len(words) - window, 0) + 1 if words else 0):
                asked = set(words[k : k + window])
                for at in range(len(own)):
                    if own[at] in asked and asked <= set(own[at : at + span]):
                        places.setdefault(item, set()).add(at)
        out += [(doc_id, str(item), len(found)) for item, found in places.items() if item is not None]
    return sorted(out, key=repr)


def test_hits_are_those_of_brute_force(spark):
    docs = frame(spark, awkward())
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert answer(docs, items) == brute(awkward(), ITEMS)


def test_blocks_of_items_give_the_same(spark):
    docs = frame(spark, awkward())
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert answer(docs, items, block_bytes=500) == brute(awkward(), ITEMS)


def test_empty_tables(spark):
    docs = frame(spark, awkward())
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(row[-1] for row in answer(docs, items))
    nothing = frame(spark, [])
    assert answer(nothing, spark.createDataFrame(ITEMS, "item_id bigint, text string")) == []


def test_proximity_matches_are_those_of_brute_force(spark):
    pick = random.Random(5)
    rows = [(k % 50, " ".join(pick.choices("abcdefg", k=pick.randint(0, 60))), "", "", 0) for k in range(60)]
    rows += [(None, "a b c " * 20, "", "", 0), (70, None, "", "", 0), (71, "red then blue and green", "", "", 0)]
    items = [(1, "green blue red"), (2, "a b a c"), (3, "g f e d c b a"), (3, "a a"), (None, "a b"), (4, None), (5, "zz a")]
    found = decontaminate.proximity(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), 4, 6)
    assert found.columns == ["doc_id", "item_id", "n_places"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_near(rows, items, 4, 6)


def test_matches_tell_the_places_of_each_item(spark):
    docs = frame(spark, [(1, "x one two three one two", "", "", 0), (2, None, "", "", 0)])
    wanted = decontaminate.windows(spark.createDataFrame([(1, "One two"), (2, "one two"), (None, "x")], "item_id int, text string"))
    found = decontaminate.matches(decontaminate.hits(decontaminate.build_index(docs), wanted), wanted)
    places = [tuple(r) for r in found.select("doc_id", "item", "first", "last").collect()]
    assert sorted(places) == [(1, "1", 1, 2), (1, "1", 4, 5), (1, "2", 1, 2), (1, "2", 4, 5)]


def test_rows_without_hits_stay_whole(spark):
    docs = frame(spark, awkward()).withColumnRenamed("n_chars", "segment")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = decontaminate.decontaminated(docs, items)
    clean = [row for row, told in zip(awkward(), [brute([r], ITEMS)[0][-1] for r in awkward()], strict=True) if not told]
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
