import pytest

from contexture.llm import licenses
from tests.llm.helpers import ALNUM, awkward, frame, lower

NOTICES = [
    (900, "Under the MIT License; under the mit license. CC-BY-NC 4.0", "", "", 0),
    (901, "// SPDX-License-Identifier: (MIT OR Apache-2.0 WITH LLVM-exception) AND BSD-3-Clause */\nx", "", "", 0),
    (902, "spdx-license-identifier: MIT OR OR", "", "", 0),
    (903, "apache license version 2 apache license version 2", "", "", 0),
]


def test_base_places_are_those_of_brute_force(spark):
    rows = awkward() + NOTICES
    found = licenses.scanned(frame(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    expected = []
    for doc_id, text, *_ in rows:
        own, places, labels = ALNUM.findall(lower(text)), [], set()
        for phrase, label in licenses.BASE.items():
            want = phrase.split()
            at = [k for k in range(len(own)) if own[k : k + len(want)] == want]
            places += at
            labels |= {label} if at else set()
        expected.append((doc_id, len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_labels_and_scores(spark):
    found = {r["doc_id"]: r for r in licenses.scanned(frame(spark, NOTICES)).collect()}
    assert found[900]["labels"] == "cc-by-nc,cc-by-nc-4.0,mit"
    assert found[901]["labels"] == "apache-2.0-with-llvm-exception,bsd-3-clause,mit"
    assert found[902]["labels"] == "" and found[902]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


@pytest.mark.parametrize(
    "expression,accepted,answer",
    [
        ("MIT", {"mit"}, True),
        ("MIT OR GPL-3.0 AND BSD", {"bsd", "gpl-3.0"}, True),
        ("(MIT OR GPL-3.0) AND BSD", {"mit"}, False),
        ("GPL-2.0+ WITH Classpath-exception-2.0", {"gpl-2.0+ with classpath-exception-2.0"}, True),
        ("((a))", {"a"}, True),
    ],
)
def test_expressions(expression, accepted, answer):
    assert licenses.satisfied(expression, accepted) is answer


@pytest.mark.parametrize("bad", ["", "OR", "a b", "(a", "a)", "a AND", "(a or b) with c", "a ! b", "()"])
def test_malformed_expressions(bad):
    with pytest.raises(licenses.Malformed):
        licenses.evaluate(licenses.to_postfix(bad))


def test_empty_table(spark):
    assert licenses.scanned(frame(spark, [])).collect() == []


@pytest.mark.parametrize(
    "line,labels",
    [
        ("MIT, see LICENSE", ["mit"]),
        ("MIT */ int main", ["mit"]),
        ("MIT Copyright (c) 2020", ["mit"]),
        ("Apache-2.0.", ["apache-2.0"]),
        ("Apache-2.0. Or ask us", ["apache-2.0"]),
        ("(MIT OR GPL-2.0+) AND BSD) and more", ["mit", "gpl-2.0+", "bsd"]),
        ("(a or b) with c", ["a", "b"]),
        ("a with b with c", ["a-with-b"]),
        ("a with (b)", ["a-with-b"]),
        ("((a) with b) or c; d", ["a-with-b", "c"]),
        ("MIT x SPDX-License-Identifier: ISC y", ["mit", "isc"]),
        ("MIT OR\nBSD", ["mit"]),
        ("MIT OR (BSD", ["mit"]),
        ("MIT OR OR", []),
        ("(MIT", []),
        ("", []),
        (", MIT", []),
    ],
)
def test_tags_in_running_text(line, labels):
    assert licenses.tag_labels(f"SPDX-License-Identifier: {line}") == labels


def test_banners_behind_a_tag_end():
    for tail in ("#" * 100_000 + "x", "*/ " * 30_000, "#" * 100_000):
        assert licenses.tag_labels("SPDX-License-Identifier: MIT " + tail) == ["mit"]
    with pytest.raises(licenses.Malformed):
        licenses.to_postfix("MIT " + "#" * 100_000 + "x")


def test_many_places_of_a_long_text_take_time_in_proportion(spark):
    """2.4 MB of nothing but phrases: counting blanks anew for each would take minutes."""
    text = "cc by nc " * 200_000 + "under the mit license apache license version 2"
    rows = [(1, text, "en", "a", 1)]
    found = licenses.scanned(frame(spark, rows, parts=1)).first()
    assert (found["n_words"], found["n_base"]) == (600_008, 200_002)
    assert (found["first_word"], found["last_word"]) == (0, 600_004)
