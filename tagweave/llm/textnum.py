"""Vectorised text kernels over Arrow string columns.

Every kernel works on the UTF-8 bytes of a slice of rows, so the memory of a
task depends on the slice (``SLICE_BYTES``, or one text when a text is longer)
and not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E6C63D0876A9A99)
STEP = np.uint64(0xD1342543DE82EF95)
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the bits of a lane's first n bytes


def byte_class(separators) -> np.ndarray:
    """Table of 256 flags: True where the byte belongs to a word."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


WHITE = [0x20, *range(0x09, 0x0E)]
WORD_BYTES = byte_class(WHITE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def row_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice has more than `most` bytes of `column`, but one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = string_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def words_of(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each row (one more entry than rows)."""
    inside = table[buf]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = offs[:-1][offs[:-1] < len(inside)]
        before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = offs[1:]
        after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _lanes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans as lanes of 8 bytes, the last one filled with zeros: values, place in the span, and the first lane of each span."""
    counts = np.maximum((ends - starts + 7) >> 3, 1)
    begin = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(begin, counts)
    at = np.repeat(starts, counts) + 8 * place
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    values = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))[at]
    values &= _TAIL[np.minimum(np.repeat(ends, counts) - at, 8)]
    return values, place, begin


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span: lanes of 8 bytes, each mixed with its place, are added up and mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values, place, begin = _lanes(buf, starts, ends)
    sums = np.add.reduceat(mix(mix(values + STEP) + place.astype(np.uint64) * BASE), begin)
    return mix(sums + (ends - starts).astype(np.uint64) * STEP)


def span_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for spans of equal bytes and no others: hashes tell candidates, all bytes are compared."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, first, ids = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    like = first[ids]
    same = (ends - starts) == (ends - starts)[like]
    if same.all():
        own, _, begin = _lanes(buf, starts, ends)
        same = np.bitwise_and.reduceat(own == _lanes(buf, starts[like], ends[like])[0], begin)
    if same.all():
        return ids
    known: dict[bytes, int] = {}  # different spans have one hash
    return np.array([known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)], np.int64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every row and the number of the first of each row.

    A row with fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(begin[-1]), np.uint64)
    at = np.arange(len(out)) + np.repeat(first[:-1] - begin[:-1], counts)
    size = np.repeat(np.minimum(n, k), counts)
    for j in range(k):
        use = size > j if len(out) and size.min() <= j else slice(None)
        h = out[use]
        out[use] = (h ^ h >> np.uint64(29)) * BASE + words[at[use] + j]  # the shift keeps the hash from being a polynomial
    return mix(out + size.astype(np.uint64)), begin


def code_points(buf: np.ndarray) -> np.ndarray:
    """1 at the first byte of each code point, else 0."""
    return (buf & 0xC0) != 0x80


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
