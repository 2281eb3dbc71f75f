import numpy as np
import pyarrow as pa
import pytest

from contexture.llm import words
from tests.llm.helpers import ALNUM, BLANK, lower, prose

TEXTS = ["Ab cd\tab", "", None, "é1-ÜX  x", " ", "\x00a\x7fb", prose(1, 3000), "a" * 400_000]


@pytest.mark.parametrize("inside,pattern", [(words.ALNUM, ALNUM), (words.NOT_BLANK, BLANK)])
def test_words_and_hashes_follow_the_pattern(inside, pattern):
    raw, offsets = words.text_bytes(pa.array(TEXTS))
    starts, ends, first = words.spans(raw, offsets, inside)
    expected = [pattern.findall(lower(text)) for text in TEXTS]
    assert np.diff(first).tolist() == [len(own) for own in expected]
    seen = {}
    for word, value in zip(sum(expected, []), words.hashes(raw, starts, ends), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_chunks_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": TEXTS})
    rows = [own for own, _, _ in words.chunks(iter([batch]), "text", limit=100)]
    assert sum(own.num_rows for own in rows) == len(TEXTS) and len(rows) > 2
