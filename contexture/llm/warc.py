"""Web archive files from pages, the same bytes whatever runs write them.

Pages are cut into shards by ranges of (page_id, payload digest). Sorted sizes are
summed up along that order, and a shard begins where the sum passes the next
multiple of ``shard_bytes``; so shards are as even for ids far apart, dense in
places, equal or null as for any, and depend on the data alone. A task
sorts its shard, writes a record per page (each its own gzip member, with
headers and digests made anew) and begins another file when the compressed size
reaches the limit. A file is written under a temporary name and renamed when
whole; as its bytes are the same for every attempt, a repeated task does no
harm. The manifest, a table written by Spark, commits the run: readers go by it.

Of pages with equal payloads of at least ``revisit_bytes``, that with the
smallest page_id is stored and the others revisit it, carrying the digest and
length of the payload but not the payload.

Defined results: a null html is an empty payload; a null url becomes
``urn:page:<page_id>``; characters a header cannot hold are percent-encoded; rows
with equal page_id and payload are one response and revisits of it; a null
page_id comes first and is stored unless a page with an id has its payload; an
empty table gives an empty manifest. Columns other than the three are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contexture.llm.tables import written
from contexture.llm.token_store import _files
from contexture.session import shared_dir

#: The driver and every task hold 29 bytes a shard: 46 MB for 100 TB.
SHARD_BYTES = 64 << 20
FILE_BYTES = 4 << 20
RECORD_BYTES = 512
DATE = "2024-01-01T00:00:00Z"

MANIFEST_SCHEMA = (
    "shard int, number int, file string, records bigint, bytes bigint, sha1 string, "
    "first_id bigint, last_id bigint"
)
RECORD_SCHEMA = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, target_uri string, file string, offset bigint"
)
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in pairs)
    return lines.encode()


def _name(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def record(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, first: object
) -> bytes:
    """One record; without a payload it revisits page ``first``."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{_name(page_id)}"
    http = b"HTTP/1.1 200 OK\r\n" + _headers(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]
    )
    block = http + b"\r\n" + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {_name(page_id)} {uri} {sha1}")
    pairs = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{own}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Page-Id", _name(page_id)),
    ]
    if payload is None:
        pairs += [("WARC-Profile", _REVISIT), ("Refers-To-Page-Id", first)]
    pairs += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return b"WARC/1.0\r\n" + _headers(pairs) + b"\r\n" + block + b"\r\n\r\n"


class _Files:
    """The files of one shard, one open at a time."""

    def __init__(self, path: str, shard: int, limit: int):
        self.path, self.shard, self.limit = path, shard, limit
        self.system, self.place = _files(path)
        if isinstance(self.system, pa.fs.LocalFileSystem):
            self.system.create_dir(self.place, recursive=True)
        self.number, self.stream = 0, None

    def add(self, page_id: int | None, data: bytes) -> dict | None:
        """Appends a record; the manifest's row if that filled the file."""
        if self.stream is None:
            self.temporary = f"{self.place}/_writing-{uuid.uuid4().hex}"
            self.stream = self.system.open_output_stream(self.temporary, compression=None)
            self.records, self.bytes, self.sha1 = 0, 0, hashlib.sha1()
            self.ids = [page_id, page_id]
        member = gzip.compress(data, compresslevel=6, mtime=0)
        self.stream.write(member)
        self.sha1.update(member)
        self.records, self.bytes, self.ids[1] = self.records + 1, self.bytes + len(member), page_id
        return self.close() if self.bytes >= self.limit else None

    def close(self) -> dict | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream = None
        name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.system.move(self.temporary, f"{self.place}/{name}")
        self.number += 1
        return {
            "shard": self.shard,
            "number": self.number - 1,
            "file": f"{self.path}/{name}",
            "records": self.records,
            "bytes": self.bytes,
            "sha1": self.sha1.hexdigest(),
            "first_id": self.ids[0],
            "last_id": self.ids[1],
        }


def _manifest(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    kinds += [pa.int64(), pa.int64()]
    names = [part.split()[0] for part in MANIFEST_SCHEMA.split(", ")]
    columns = [pa.array([row[n] for row in rows], k) for n, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _place() -> Column:
    """Bytes that sort as page_id (nulls first) and then payload digest."""
    number = F.expr("page_id ^ -9223372036854775808L")
    number = F.unhex(F.lpad(F.hex(F.coalesce(number, F.lit(0).cast("bigint"))), 16, "0"))
    known = F.when(F.col("page_id").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    return F.concat(known, number, F.col("sha1"))


def shard_begins(sized: DataFrame, shard_bytes: int) -> list[bytes]:
    """The first place of every shard but the first, in order.

    Equal places are one row. Each range partition is summed up by itself; what
    lies before it is the sum of the ones before. Collected: a number a partition,
    and a place a shard.
    """
    weight = (F.col("size") + RECORD_BYTES).alias("weight")
    places = sized.select(_place().alias("place"), weight)
    places = places.groupBy("place").agg(F.sum("weight").alias("weight"))
    parts = max(1, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = places.repartitionByRange(parts, "place")
    places = written(places.withColumn("part", F.spark_partition_id()), "places")
    sums = places.groupBy("part").agg(F.sum("weight").alias("weight")).orderBy("part").collect()
    total = sum(row["weight"] for row in sums)
    if total <= shard_bytes:
        return []
    before, held = [], 0
    for row in sums:
        before.append((row["part"], held))
        held += row["weight"]
    before = sized.sparkSession.createDataFrame(before, "part int, base bigint")
    rows = places.join(before, "part")
    own = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("upto", F.col("base") + F.coalesce(F.sum("weight").over(own), F.lit(0)))
    shard = F.expr(f"upto div {shard_bytes}")
    firsts = rows.groupBy(shard.alias("shard")).agg(F.min("place").alias("place"))
    return sorted(bytes(row["place"]) for row in firsts.where("shard > 0").collect())


def _shard_of(begins: list[bytes]) -> Column:
    """The shard of a row with ``page_id`` and ``sha1``."""
    if not begins:
        return F.lit(0)
    known = np.array(begins, dtype="S29")

    @F.pandas_udf("int")
    def shard(place: pd.Series) -> pd.Series:
        own = np.array(place.tolist(), dtype="S29")
        return pd.Series(np.searchsorted(known, own, side="right").astype(np.int32))

    return shard(_place())


def write(
    pages: DataFrame,
    path: str,
    revisit_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes the archive below ``path`` and returns its manifest, a row a file."""
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    pages = pages.withColumn("sha1", F.unhex(F.sha1("payload")))
    pages = pages.withColumn("size", F.octet_length("payload").cast("bigint"))
    narrow = written(pages.select("page_id", "sha1", "size"), "digests")
    begins = shard_begins(narrow, shard_bytes)
    shards, place = len(begins) + 1, _shard_of(begins)
    copies = (
        narrow.where(F.col("size") >= revisit_bytes)
        .groupBy("sha1", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("sha1", "size", "first")
    )
    # What to do with a copy goes to its shard as a row of its own ahead of the
    # page, so payloads are shuffled once.
    shard = place.alias("shard")
    notes = narrow.join(copies, ["sha1", "size"]).select(shard, "page_id", "sha1", "first")
    notes = notes.distinct().withColumn("note", F.lit(0))
    rows = pages.select(shard, "page_id", "sha1", "url", "size", "payload", F.lit(1).alias("note"))
    rows = rows.unionByName(notes, allowMissingColumns=True)
    rows = rows.repartitionById(shards, F.col("shard"))
    rows = rows.sortWithinPartitions(F.col("page_id").asc_nulls_first(), "sha1", "note", "url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = None, []
        copied = stored = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                key = row["page_id"], row["sha1"]
                if row["note"] == 0:
                    copied, first = key, row["first"]
                    continue
                files = files or _Files(path, row["shard"], file_bytes)
                payload, of = row["payload"], ""
                if key == copied:
                    if first != row["page_id"] or key == stored:
                        payload, of = None, _name(first)
                    stored = key
                sha1 = base64.b32encode(row["sha1"]).decode()
                if payload is not None and digest(payload) != sha1:
                    raise OSError(f"payload of page {row['page_id']} changed on its way")
                data = record(row["page_id"], row["url"], payload, row["size"], sha1, of)
                done += [files.add(row["page_id"], data)]
        if files:
            done += [files.close()]
        yield _manifest([row for row in done if row])

    return written(rows.mapInArrow(put, MANIFEST_SCHEMA), "warc-manifest")


def _members(stream: io.RawIOBase) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member."""
    at, held = 0, b""
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            return
        machine, parts, start = zlib.decompressobj(31), [], at
        while not machine.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    raise EOFError("a record is cut short")
            parts.append(machine.decompress(held))
            at += len(held) - len(machine.unused_data)
            held = machine.unused_data
        yield start, b"".join(parts)


def _parsed(data: bytes, file: str, offset: int) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    own = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(own["Content-Length"])]
    if digest(block) != own["WARC-Block-Digest"].removeprefix("sha1:"):
        raise OSError(f"damaged record at {offset} of {file}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b": ")[2])
    sha1 = own["WARC-Payload-Digest"].removeprefix("sha1:")
    if own["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha1):
        raise OSError(f"damaged payload at {offset} of {file}")
    return {
        "page_id": int(own["Page-Id"]) if own["Page-Id"].strip() else None,
        "payload_bytes": size,
        "payload_digest": sha1,
        "record_type": own["WARC-Type"],
        "refers_to": int(own["Refers-To-Page-Id"]) if own.get("Refers-To-Page-Id", "").strip() else None,
        "target_uri": own["WARC-Target-URI"],
        "file": file,
        "offset": offset,
    }


def read(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, every digest checked."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        kinds += [pa.string(), pa.string(), pa.int64()]
        names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, place = _files(file)
                with system.open_input_stream(place, compression=None) as stream:
                    found = [_parsed(data, file, at) for at, data in _members(stream)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)],
                    names=names,
                )

    files = manifest.select("file")
    count = max(1, files.count())
    return files.repartition(count, "file").mapInArrow(get, RECORD_SCHEMA)


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` below the shared folder and reads the archive back."""
    return read(write(pages, shared_dir(pages.sparkSession, "warc")))
