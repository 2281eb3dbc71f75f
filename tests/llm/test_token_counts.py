from collections import defaultdict

import pytest

from contexture.llm.token_counts import Rollup
from contexture.session import shared_dir

SCHEMA = "doc_id bigint, version string, source string, lang string, tokens bigint, op string, seq int"
BATCHES = [
    [(1, "v", "a", "en", 10, "insert", 0), (2, "v", "a", None, 5, "insert", 0), (None, "v", None, "en", 7, "insert", 0), (3, "v", "b", "en", None, "insert", 0)],
    [(1, "v", "a", "en", 12, "revise", 0), (2, "v", None, None, 0, "delete", 0), (9, "v", "b", "de", 4, "revise", 0), (8, "v", "x", "x", 1, "delete", 0)],
    [],
    [(1, "v", "b", "en", 3, "insert", 0), (1, "w", "b", "en", 4, "insert", 0), (1, "w", "b", "en", 6, "revise", 1), (1, "w", "b", "en", 6, "revise", 1)],
    [(2, "v", "c", "fr", 9, "insert", 0), (None, "v", "q", "q", 0, "delete", 0)],
]


def brute(batches):
    now = {}
    for batch in batches:
        for doc, version, source, lang, tokens, op, _ in sorted(batch, key=lambda r: r[-1]):
            now.pop((doc, version), None) if op == "delete" else now.__setitem__((doc, version), (source, lang, tokens or 0))
    sums = defaultdict(lambda: [0, 0])
    for (_, version), (source, lang, tokens) in now.items():
        sums[source, lang, version][0] += 1
        sums[source, lang, version][1] += tokens
    return sorted(((*key, *value) for key, value in sums.items()), key=repr)


@pytest.mark.parametrize("upto", range(1, len(BATCHES) + 1))
def test_totals_after_each_batch_delivered_twice(spark, upto):
    rollup = Rollup(spark, shared_dir(spark, "counts"))
    for number, batch in enumerate(BATCHES[:upto]):
        changes = spark.createDataFrame(batch, SCHEMA)
        assert rollup.commit(number, changes) and not rollup.commit(number, changes)
    assert sorted((tuple(r) for r in rollup.totals().collect()), key=repr) == brute(BATCHES[:upto])


def test_an_attempt_without_its_marker_is_not_read(spark):
    path = shared_dir(spark, "counts")
    rollup = Rollup(spark, path)
    rollup.commit(0, spark.createDataFrame(BATCHES[0], SCHEMA))
    stray = spark.createDataFrame([("a", "en", "v", 100, 100)], "source string, lang string, version string, documents bigint, tokens bigint")
    stray.write.parquet(f"{path}/delta/000000001-stray")
    assert sorted((tuple(r) for r in rollup.totals().collect()), key=repr) == brute(BATCHES[:1])
    with pytest.raises(ValueError):
        rollup.commit(-1, spark.createDataFrame(BATCHES[1], SCHEMA))


def test_nothing_committed(spark):
    assert Rollup(spark, shared_dir(spark, "counts")).totals().collect() == []
