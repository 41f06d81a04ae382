"""Words of whole Arrow batches as hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_FACTOR = 0x9E3779B1
_POWERS = np.array([pow(_FACTOR, k, 1 << 32) for k in range(256)], np.uint32)
#: Bytes that are part of words: ASCII letters and digits, and all bytes of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text). Words are lower-cased runs of letters and digits; nulls have none."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, lower.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.uint32), np.zeros(len(lower), np.int64)
    data = np.frombuffer(lower.buffers()[2], np.uint8, last - first, first)
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1] - first
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]  # a text begins a word of its own
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(lower), np.int64)
    where = np.flatnonzero(inside)  # bytes of words, in order
    of = np.searchsorted(where, starts)
    sizes = np.diff(np.append(of, len(where)))
    place = np.arange(len(where)) - np.repeat(of, sizes)
    mixed = (data[where].astype(np.uint32) + np.uint32(1)) * _POWERS[place & 255]
    h = np.add.reduceat(mixed, of, dtype=np.uint32)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    counts = np.diff(np.searchsorted(starts, offsets - first))
    return h, counts


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes, a single longer text being a part by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
