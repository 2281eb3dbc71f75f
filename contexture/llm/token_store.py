"""Token ids as binary shards with a minimal perfect hash index over their keys.

``encode`` range-sorts documents by key, encodes each text, and lets every task
write one shard: a file of raw ids, one after the other, and a file with the
index. Ids are 16-bit little-endian where the vocabulary allows, else 32-bit.
The index holds no keys. Levels of bit arrays (each as long as the keys still
without a place; a key that meets another goes on to the next level) give every
key of the shard a number of its own from 0 to n - 1. Under that number stand a
fingerprint of the key, the key's first record and how many it has. So a lookup
is a few probes, whatever the size of the shard, and an unknown key is told by
its fingerprint (a false find has a chance of 2^-32).

Files are written under names of the attempt that writes them, and the manifest,
a table written by Spark, lists those of the attempts that count; a lost or
repeated attempt leaves a file that nothing refers to.

Defined results: null and empty texts have no ids but the end id; a repeated key
has a record for each row, in order of text; a null key is a key like others and
comes first; an empty table has an empty manifest. Columns other than key and
text are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contexture.llm import words
from contexture.llm.tables import written
from contexture.session import shared_dir

END_ID = 2
KNOWN_PIECES = 1 << 20

MANIFEST_SCHEMA = (
    "shard int, first bigint, last bigint, has_null boolean, ids string, index string, "
    "documents bigint, tokens bigint, width int"
)
RECORD_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int"


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path; ``s3a`` and ``s3n`` are ``s3``."""
    head, sep, rest = path.partition("://")
    if sep and head in ("s3a", "s3n"):
        path = f"s3://{rest}"
    if not sep and path.startswith("file:"):
        path = path[len("file:") :]
    return pa.fs.FileSystem.from_uri(path)


# --- encoding -------------------------------------------------------------


#: What a tokenizer does first if its texts may be cut into pieces.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_into_pieces(tokenizer: str) -> bool:
    """Whether a tokenizer, as JSON, is of the kind whose texts may be cut into pieces.

    It has to lower-case, drop white space and cut between letters and marks before
    it looks for anything else, mark the ends of words, and find special tokens by
    ``<|`` only.
    """
    told = json.loads(tokenizer)
    first = (told.get("normalizer") or {}).get("normalizers")
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = cuts[0]
    model = told.get("model") or {}
    return (
        first == _NORMALIZERS
        and [cut.get("type") for cut in cuts] == ["Split", "ByteLevel"]
        and split.get("pattern") == {"Regex": _PIECES}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and not cuts[1].get("add_prefix_space")
        and not cuts[1].get("use_regex")
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and told.get("truncation") is None
        and all(token["content"].startswith("<|") for token in told.get("added_tokens") or [])
    )


class Encoder:
    """Ids of texts.

    A tokenizer that lower-cases and cuts at white space and between letters and
    marks before anything else (``cuts_into_pieces``) gives a text the ids of its
    pieces end to end: the words between ASCII blanks, a last run of ``.,;:!?``
    after a letter apart. Pieces seen before, known by 64-bit hash and length, are
    not encoded again; the memory for them is bounded. A text with ``<|`` may hold a
    special token's name and is encoded as it stands, and so is every text of any
    other tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.in_pieces = cuts_into_pieces(self.tokenizer.to_str())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.ends = np.zeros(size, dtype=bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.begins = np.empty(0, dtype=np.int64)
        self.sizes = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces end to end, and how many each has."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        lists = [one.ids for one in found]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _encode_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters: as one text, cut after each word's end."""
        ids, _ = self._encode([" ".join(pieces)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            return self._encode(pieces)
        return ids, np.diff(stops, prepend=0)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        plain = np.array([bool(_LETTERS.fullmatch(piece)) for piece in pieces], dtype=bool)
        for mask, encode in ((plain, self._encode_words), (~plain, self._encode)):
            chosen = np.flatnonzero(mask)
            for begin in range(0, len(chosen), _TOGETHER):
                own = chosen[begin : begin + _TOGETHER]
                ids, sizes = encode([pieces[k] for k in own])
                self.keys = np.concatenate([self.keys, keys[own]])
                starts = len(self.ids) + np.cumsum(sizes) - sizes
                self.begins = np.concatenate([self.begins, starts])
                self.sizes = np.concatenate([self.sizes, sizes])
                self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.begins = self.keys[order], self.begins[order]
        self.sizes = self.sizes[order]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each with the end id, and where each begins."""
        if not self.in_pieces:
            return self._whole(raw, offsets)
        marks = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
        special = np.unique(np.searchsorted(offsets, marks, side="right") - 1)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        row = 0
        for at in [*special.tolist(), len(offsets) - 1]:
            if at > row:
                low, high = offsets[row], offsets[at]
                parts.append(self._plain(raw[low:high], offsets[row : at + 1] - low))
            if at < len(offsets) - 1:
                text = raw[offsets[at] : offsets[at + 1]].tobytes().decode("utf-8", "replace")
                ids, sizes = self._encode([text])
                parts.append((np.append(ids, np.uint32(END_ID)), np.array([0, sizes[0] + 1])))
            row = at + 1
        shift, begins = 0, [np.zeros(1, dtype=np.int64)]
        for ids, own in parts:
            begins.append(own[1:] + shift)
            shift += len(ids)
        return np.concatenate([ids for ids, _ in parts] or [self.ids[:0]]), np.concatenate(begins)

    def _whole(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        bounds = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ids, sizes = self._encode([data[a:b].decode("utf-8", "replace") for a, b in bounds])
        ends = np.cumsum(sizes)
        begins = np.concatenate([[0], ends]) + np.arange(len(offsets))
        return np.insert(ids, ends, np.uint32(END_ID)), begins

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > KNOWN_PIECES:
            self._forget()
        starts, ends, first = words.spans(raw, offsets, words.NOT_BLANK)
        cores = ends.copy()
        open_ = np.arange(len(cores))
        while len(open_):
            open_ = open_[_MARKS[raw[cores[open_] - 1]]]
            cores[open_] -= 1
            open_ = open_[cores[open_] > starts[open_]]
        cores = np.where(_ends_in_letter(raw, starts, cores), cores, ends)
        tail = cores < ends
        count = 1 + tail.astype(np.int64)
        place = np.concatenate([[0], np.cumsum(count)])
        lows, highs = np.repeat(starts, count), np.repeat(cores, count)
        lows[place[:-1][tail] + 1] = cores[tail]
        highs[place[:-1][tail] + 1] = ends[tail]
        length = (highs - lows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys = words.mix(words.hashes(raw, lows, highs) + length)
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(distinct))
        if len(new):
            lowered = words.LOWER[raw].tobytes()
            own = at[new]
            bounds = zip(lows[own].tolist(), highs[own].tolist(), strict=True)
            pieces = [lowered[a:b].decode("utf-8", "replace") for a, b in bounds]
            self._learn(distinct[new], pieces)
        if not len(distinct):
            sizes, ends_ = np.empty(0, np.int64), np.zeros(1, np.int64)
            ids = self.ids[:0]
        else:
            spot = np.searchsorted(self.keys, distinct)
            begins, sizes = self.begins[spot][inverse], self.sizes[spot][inverse]
            ends_ = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.ids[np.repeat(begins - ends_[:-1], sizes) + np.arange(ends_[-1])]
        begins = ends_[place[first]]
        ids = np.insert(ids, begins[1:], np.uint32(END_ID))
        return ids, begins + np.arange(len(begins))


def _ends_in_letter(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the piece's last character is an ASCII letter or digit or a Latin letter.

    Only there does the tokenizer surely cut before a mark. Two-byte characters
    from U+00C0 to U+023F are letters, but for U+00D7 and U+00F7; U+0130 is left
    out, as lower-casing adds a mark to it.
    """
    full = ends > starts
    last = raw[np.maximum(ends - 1, 0)]
    lead = np.where(ends - 2 >= starts, raw[np.maximum(ends - 2, 0)], 0)
    two = (lead >= 0xC3) & (lead <= 0xC8) & (last >= 0x80)
    two &= ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    two &= ~((lead == 0xC4) & (last == 0xB0))
    return full & (two | (_ASCII_WORD[last]))


_ASCII_WORD = words.ALNUM.copy()
_ASCII_WORD[0x80:] = False
_TOGETHER = 20_000
_LETTERS = re.compile("[a-zÀ-ÖØ-öø-ɏ]+")
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b".,;:!?")] = True
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the index --------------------------------------------------------------


def _hashed(keys: np.ndarray, null: np.ndarray, seed: int) -> np.ndarray:
    value = words.mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    value[null] = words.mix(np.array([0x5851F42D4C957F2D], dtype=np.uint64))[0] ^ np.uint64(1)
    return words.mix(value + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


@dataclass
class PerfectHash:
    """Numbers 0 to n - 1 for n keys, from levels of bit arrays."""

    sizes: list[int]
    bits: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, null: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        left, left_null = keys, null
        while len(left):
            size = -(-len(left) * 5 // 4 // 64) * 64
            at = _hashed(left, left_null, len(sizes) + 2) % np.uint64(size)
            met = np.bincount(at.astype(np.int64), minlength=size)
            parts.append(met == 1)
            again = met[at.astype(np.int64)] > 1
            left, left_null = left[again], left_null[again]
            sizes.append(size)
        packed = np.concatenate([np.packbits(p, bitorder="little") for p in parts] or [b""])
        return cls.packed(sizes, packed.astype(np.uint8).tobytes())

    @classmethod
    def packed(cls, sizes: list[int], data: bytes) -> PerfectHash:
        bits = np.frombuffer(data, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])
        return cls(sizes, bits, ranks)

    def __call__(self, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where the bits show that there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _hashed(keys[open_], null[open_], level + 2) % np.uint64(size)
            at = at.astype(np.int64) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            own = self.bits[word]
            hit = (own >> bit) & np.uint64(1) == 1
            below = own & ((np.uint64(1) << bit) - np.uint64(1))
            number = self.ranks[word] + np.bitwise_count(below).astype(np.int64)
            out[open_[hit]] = number[hit]
            open_ = open_[~hit]
            base += size
        return out


def _index_bytes(keys: np.ndarray, null: np.ndarray, ends: np.ndarray) -> bytes:
    """The index of a shard whose records, sorted by key, end at ``ends``."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(new)
    own, own_null = keys[first], null[first]
    hash_ = PerfectHash.of(own, own_null)
    number = hash_(own, own_null)
    prints = np.empty(len(own), dtype=np.uint32)
    prints[number] = (_hashed(own, own_null, 1) >> np.uint64(32)).astype(np.uint32)
    firsts = np.empty(len(own), dtype=np.uint32)
    firsts[number] = first
    counts = np.empty(len(own), dtype=np.uint32)
    counts[number] = np.diff(np.append(first, len(keys)))
    head = json.dumps({"levels": hash_.sizes, "keys": len(own), "records": len(keys)}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    parts = [len(head).to_bytes(8, "little"), head, hash_.bits.tobytes()]
    parts += [ends.astype(np.uint64).tobytes(), prints.tobytes(), firsts.tobytes()]
    return b"".join([*parts, counts.tobytes()])


class Shard:
    """Keyed access to one shard."""

    def __init__(self, ids: str, index: str, width: int):
        files, path = _files(index)
        with files.open_input_stream(path) as stream:
            data = stream.read()
        size = int.from_bytes(data[:8], "little")
        head = json.loads(data[8 : 8 + size])
        at = 8 + size
        bits = sum(head["levels"]) // 8
        self.hash = PerfectHash.packed(head["levels"], data[at : at + bits])
        at += bits
        self.ends = np.frombuffer(data, np.uint64, head["records"], at).astype(np.int64)
        at += 8 * head["records"]
        self.prints, self.firsts, self.counts = (
            np.frombuffer(data, np.uint32, head["keys"], at + 4 * k * head["keys"])
            for k in range(3)
        )
        files, path = _files(ids)
        self.file = files.open_input_file(path)
        self.type = np.dtype("<u2" if width == 2 else "<u4")

    def records(self, keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records if it is unknown."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        number = self.hash(keys, null)
        wanted = (_hashed(keys, null, 1) >> np.uint64(32)).astype(np.uint32)
        found = (number >= 0) & (self.prints[number] == wanted)
        return self.firsts[number].astype(np.int64), np.where(found, self.counts[number], 0)

    def ids(self, record: int) -> np.ndarray:
        """The ids of a record, read from its place in the file."""
        begin = int(self.ends[record - 1]) if record else 0
        size = self.type.itemsize
        data = self.file.read_at((int(self.ends[record]) - begin) * size, begin * size)
        return np.frombuffer(data, dtype=self.type)


# --- writing and reading with Spark ------------------------------------------


def encode(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """Writes the shards below ``path`` and returns the manifest, a row a shard."""
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    by = [F.col("doc_id").asc_nulls_first()]
    rows = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)
    rows = rows.sortWithinPartitions(*by, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, stem = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder = _encoder(tokenizer)
        kind = np.dtype("<u2" if encoder.width == 2 else "<u4")
        names = [f"{path}/shard-{shard:06d}-{stem}.{end}" for end in ("bin", "idx")]
        keys, nulls, ends, total = [], [], [], 0
        files, place = _files(names[0])
        stream = None
        for batch, raw, offsets in words.chunks(batches, "text"):
            if stream is None:
                if isinstance(files, pa.fs.LocalFileSystem):
                    files.create_dir(place.rpartition("/")[0], recursive=True)
                stream = files.open_output_stream(place)
            column = batch.column("doc_id")
            nulls.append(column.is_null().to_numpy(zero_copy_only=False))
            keys.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            ids, begins = encoder(raw, offsets)
            stream.write(ids.astype(kind).tobytes())
            ends.append(total + begins[1:])
            total += len(ids)
        if stream is None:
            return
        stream.close()
        keys, nulls, ends = np.concatenate(keys), np.concatenate(nulls), np.concatenate(ends)
        files, place = _files(names[1])
        with files.open_output_stream(place) as stream:
            stream.write(_index_bytes(keys, nulls, ends))
        known = keys[~nulls]
        row = {
            "shard": shard,
            "first": int(known[0]) if len(known) else None,
            "last": int(known[-1]) if len(known) else None,
            "has_null": bool(nulls.any()),
            "ids": names[0],
            "index": names[1],
            "documents": len(keys),
            "tokens": total,
            "width": encoder.width,
        }
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        kinds += [pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row)
        )

    return written(rows.mapInArrow(write, MANIFEST_SCHEMA), "token-manifest")


def lookup(manifest: DataFrame, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The records of the given keys, through the index and from the files.

    ``start`` counts the ids of all records before it in the store. A key that
    the store does not have gives no row. The manifest, a row a shard, is held
    by the driver and every task; keys are range-sorted, so a task opens few
    shards, one at a time. There are as many tasks as shards: keys are few bytes,
    by which Spark would put millions into one task, but each has its ids read.
    """
    shards = [row.asDict() for row in manifest.orderBy("shard").collect()]
    base = [0, *itertools.accumulate(row["tokens"] for row in shards)]
    sent = keys.sparkSession.sparkContext.broadcast((shards, base))
    wanted = keys.select(F.col(doc_id).cast("bigint").alias("doc_id")).distinct()
    wanted = wanted.repartitionByRange(max(1, len(shards)), F.col("doc_id").asc_nulls_first())
    wanted = wanted.sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, base = sent.value
        full = [k for k, row in enumerate(shards) if row["last"] is not None]
        lasts = [shards[k]["last"] for k in full]
        open_at, shard = -1, None
        for batch in batches:
            column = batch.column("doc_id")
            null = column.is_null().to_numpy(zero_copy_only=False)
            own = column.fill_null(0).to_numpy(zero_copy_only=False)
            # Equal keys are in one shard: ranges are cut between keys.
            place = np.searchsorted(np.array(lasts, dtype=np.int64), own)
            for spot in sorted({-1 if n else int(p) for n, p in zip(null, place, strict=True)}):
                if spot == -1:
                    holders = [k for k, row in enumerate(shards) if row["has_null"]]
                    mine = null
                else:
                    holders = [full[spot]] if spot < len(full) else []
                    mine = ~null & (place == spot)
                for holder in holders:
                    if holder != open_at:
                        row = shards[holder]
                        shard, open_at = Shard(row["ids"], row["index"], row["width"]), holder
                    yield _found(shard, own[mine], null[mine], base[holder], shards[holder]["shard"])

    return wanted.mapInArrow(find, RECORD_SCHEMA)


def _found(
    shard: Shard, keys: np.ndarray, null: np.ndarray, base: int, number: int
) -> pa.RecordBatch:
    first, count = shard.records(keys, null)
    ids, is_null, starts, sizes, crcs = [], [], [], [], []
    for key, none, record, many in zip(keys, null, first, count, strict=True):
        for k in range(int(record), int(record) + int(many)):
            own = shard.ids(k)
            ids.append(int(key))
            is_null.append(bool(none))
            starts.append(base + (int(shard.ends[k - 1]) if k else 0))
            sizes.append(len(own))
            crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=np.array(is_null, dtype=bool)),
            "start": pa.array(starts, pa.int64()),
            "n_tokens": pa.array(sizes, pa.int64()),
            "ids_crc32": pa.array(crcs, pa.int64()),
            "shard": pa.array([number] * len(ids), pa.int32()),
        }
    )


def stored(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes ``docs`` below the shared folder and reads every document back by its key."""
    manifest = encode(docs, tokenizer, shared_dir(docs.sparkSession, "tokens"))
    return lookup(manifest, docs)


def default_tokenizer() -> str:
    """The word-level BPE vocabulary of the public tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

