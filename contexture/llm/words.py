"""Words of Arrow text columns as numpy arrays of 64-bit hashes.

Texts are handled as the UTF-8 bytes Arrow already holds, a few megabytes at a
time, so a pass costs a handful of vector operations per byte and no Python
object per word. Two words are taken as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words [^\x20\x09-\x0D]+ : everything but blanks.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

# Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits,
# a-z and all of UTF-8's lead and continuation bytes.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

CHUNK_BYTES = 1 << 20
_SLICE = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < count:
        step = min(done, count - done)
        factor = np.uint64(pow(base, done, 1 << 64))
        out[done : done + step] = out[:step] * factor
        done += step
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    size = _SLICE * 2
    while size < count:
        size *= 2
    if size not in _TABLES:
        inverse = pow(_BASE, -1, 1 << 64)
        made = _powers(_BASE, size), _powers(inverse, size)
        if size > _SLICE * 2:
            return made  # for one very long word; not kept
        _TABLES[size] = made
    return _TABLES[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each row's begin and end.

    A null row is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to about ``limit`` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), batch.num_rows)
            yield (
                batch.slice(row, stop - row),
                raw[offsets[row] : offsets[stop]],
                offsets[row : stop + 1] - offsets[row],
            )
            row = stop


def spans(
    raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (one more at the end)."""
    if not len(raw):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    mask = inside[raw]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = mask[begin]
    last[begin[1:] - 1] = mask[begin[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased."""
    out = np.empty(len(starts), dtype=np.uint64)
    word = 0
    while word < len(starts):
        origin = starts[word]
        stop = int(np.searchsorted(ends, origin + _SLICE, side="right"))
        stop = max(stop, word + 1)
        length = int(ends[stop - 1] - origin)
        power, inverse = _tables(length)
        values = LOWER[raw[origin : origin + length]].astype(np.uint64)
        values += np.uint64(1)
        values *= power[:length]
        total = np.empty(length + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(values, out=total[1:])
        at = starts[word:stop] - origin
        part = total[ends[word:stop] - origin] - total[at]
        out[word:stop] = part * inverse[at]
        word = stop
    return mix(out)
