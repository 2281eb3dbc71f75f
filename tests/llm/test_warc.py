import base64
import hashlib

import pytest

from contexture.llm import warc
from contexture.session import shared_dir

SCHEMA = "page_id bigint, url string, html string"
PAGES = [
    (5, "http://a/b c\r\nX: y", "<p>é</p>"),
    (2, None, "<p>é</p>"),
    (9, "http://x", None),
    (3, "", ""),
    (3, "http://x", ""),
    (7, "http://x", "x" * 3_000_000),
    (7, "http://x", "x" * 3_000_000),
    (8, "http://y", "WARC/1.0\r\n\r\nHTTP/1.1"),
    (None, "http://n", "null id"),
    (None, "http://n", "null id"),
    (None, "http://n", "<p>é</p>"),
] + [(20 + k, f"http://z/{k}", f"page {k % 30}") for k in range(90)]


def brute(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    out, used = [], set()
    for page, payload in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        same = [p for p, own in data if own == payload]
        first = min((p for p in same if p is not None), default=None)
        stored = page == first and payload not in used
        used |= {payload} if stored else set()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if stored else "revisit", None if stored else first))
    return sorted(out, key=repr)


def rows_of(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


@pytest.mark.parametrize("shard_bytes,file_bytes", [(1 << 24, 1 << 22), (2000, 500)])
def test_records_come_back(spark, shard_bytes, file_bytes):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    made = warc.write(pages, shared_dir(spark, "warc"), 0, shard_bytes, file_bytes)
    assert rows_of(warc.read(made)) == brute(PAGES)


def test_files_are_the_same_for_every_run(spark):
    def files(parts):
        pages = spark.createDataFrame(PAGES, SCHEMA).repartition(parts)
        made = warc.write(pages, shared_dir(spark, "warc"), 0, 4000, 700)
        return sorted((r["file"].rpartition("/")[2], r["sha1"], r["records"]) for r in made.collect())

    assert files(1) == files(4) and len(files(2)) > 3


def test_small_payloads_are_all_stored(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], SCHEMA)
    made = warc.write(pages, shared_dir(spark, "warc"), revisit_bytes=3)
    assert [r[3] for r in rows_of(warc.read(made))] == ["response", "response", "response", "revisit"]


def test_damage_is_noticed():
    data = bytearray(warc.record(1, "u", b"abc", 3, warc.digest(b"abc"), ""))
    data[-6] ^= 1
    with pytest.raises(OSError):
        warc._parsed(bytes(data), "f", 0)


def test_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.archived(pages).collect() == []


@pytest.mark.parametrize("ids", [[10**7], [10**12], [-(2**63), 2**63 - 1], [10**15, None]])
def test_far_off_ids_leave_the_shards_even(spark, ids):
    rows = [(k, f"http://x/{k}", f"page {k} " + "x" * 100) for k in range(600)]
    rows += [(i, "http://far", f"far {i}") for i in ids]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write(pages, shared_dir(spark, "warc"), shard_bytes=20_000)
    counts = [r["records"] for r in manifest.groupBy("shard").sum("records").toDF("shard", "records").collect()]
    assert len(counts) > 15 and max(counts) < 60 and sum(counts) == len(rows)
    assert rows_of(warc.read(manifest)) == brute(rows)


def test_equal_and_null_ids_are_split(spark):
    rows = [(None if k % 2 else 7, "http://x", f"page {k} " + "x" * 100) for k in range(400)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write(pages, shared_dir(spark, "warc"), shard_bytes=20_000)
    counts = [r["records"] for r in manifest.groupBy("shard").sum("records").toDF("shard", "records").collect()]
    assert len(counts) > 10 and max(counts) < 60
    found = rows_of(warc.read(manifest))
    assert sorted((r[0] or 0, r[2]) for r in found) == sorted((r[0] or 0, r[2]) for r in brute(rows))


def test_columns_with_clashing_names(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    for name in ("payload", "sha1", "size", "shard", "note", "first", "place", "weight"):
        pages = pages.withColumn(name, pages.url)
    assert rows_of(warc.archived(pages)) == brute(PAGES)
