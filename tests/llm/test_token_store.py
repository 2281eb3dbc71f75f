import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from contexture.llm import token_store, words
from contexture.session import shared_dir
from tests.llm.helpers import awkward, frame

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return token_store.default_tokenizer()


def brute(rows, path):
    own = tokenizers.Tokenizer.from_file(path)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for doc_id, text, *_ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        out.append((doc_id, start, len(ids), crc))
        start += len(ids)
    return sorted(out, key=repr)


EXTRA = [
    (500, "tab\tand line\u0085 sep\x1c <|endoftext|> it's 12345 ΑΣ é ́x", "", "", 0),
    (501, "\n\n  ", "", "", 0),
    (502, "... Word, WORD. word?! ...,a It's,it'S É. ÀÉß; İx ŉ ΑΣ. x\u0301. don't'll 3.5, !", "", "", 0),
    (503, "<|ENDOFTEXT|> <|startoftext|>x a<|b", "", "", 0),
]


def test_ids_are_those_of_the_tokenizer(spark, path):
    rows = awkward() + EXTRA
    found = token_store.stored(frame(spark, rows), path).drop("shard")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, path)


def test_bounded_memory_changes_nothing(spark, path, monkeypatch):
    monkeypatch.setattr(token_store, "KNOWN_PIECES", 3)
    encoder = token_store.Encoder(path)
    plain = tokenizers.Tokenizer.from_file(path)
    for text in ["a b c d e f", "g a b", None, ""]:
        ids, begins = encoder(*words.text_bytes(pa.array([text], pa.string())))
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert begins.tolist() == [0, len(ids)]


def test_unknown_keys_are_not_found(spark, path):
    docs = frame(spark, awkward())
    manifest = token_store.encode(docs, path, shared_dir(spark, "tokens"), shards=3)
    keys = spark.createDataFrame([(0,), (77_777,), (-5,), (None,)], "doc_id bigint")
    found = token_store.lookup(manifest, keys)
    assert sorted((r["doc_id"] for r in found.collect()), key=repr) == [0, None, None]


def test_empty_table(spark, path):
    assert token_store.stored(frame(spark, []), path).collect() == []


def test_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    null = np.zeros(len(keys), dtype=bool)
    null[0] = True
    hash_ = token_store.PerfectHash.of(keys, null)
    assert sorted(hash_(keys, null).tolist()) == list(range(len(keys)))


def test_ids_of_other_tokenizers(spark, path, tmp_path):
    """One that keeps case and blanks, and one that differs from the usual in its case only."""
    import json

    import public_tokenizers

    kept = json.loads(open(path).read())
    kept["normalizer"]["normalizers"] = kept["normalizer"]["normalizers"][:2]
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(kept))
    rows = awkward() + EXTRA + [(600, "Hello World, it's a Test.", "", "", 0)]
    for other in (public_tokenizers.path("byte_bpe_50k.json"), str(cased)):
        assert not token_store.Encoder(other).in_pieces
        found = token_store.stored(frame(spark, rows), other).drop("shard")
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, other)
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    raw = np.frombuffer(b"Hello World, it's a Test.", np.uint8)
    ids, _ = encoder(raw, np.array([0, len(raw)]))
    assert ids.tolist()[:4] == [15496, 2159, 11, 340]
    assert token_store.Encoder(path).in_pieces


def test_records_are_looked_up_in_a_task_per_shard(spark, path):
    docs = frame(spark, [(k, f"text number {k}", "en", "s", 9) for k in range(400)])
    manifest = token_store.encode(docs, path, shared_dir(spark, "tokens"), shards=6)
    found = token_store.lookup(manifest, docs)
    assert found.count() == 400 and found.rdd.getNumPartitions() == manifest.count() == 6
