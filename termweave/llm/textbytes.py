"""Vectorised helpers over the UTF-8 bytes of a column of texts.

A column is seen as one byte array and the offsets of its texts. All hashes are 64 bits wide: a
polynomial over random values per byte, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once; temporary arrays take about 60 bytes for each.
SLICE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_value = np.random.default_rng(7).integers(1, _MASK, 256, dtype=np.uint64)


def columns(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes together; a longer text is a range alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums S with S[b] - S[a] = P^a * (polynomial of bytes a..b); for at most two slices of bytes."""
    power, _ = _powers(2 * SLICE + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_value[data] * power[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed polynomial of each span of bytes."""
    _, inverse = _powers(2 * SLICE + 1)
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and the number of words in each text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word in order, and the number of words in each text."""
    starts, ends, counts = word_spans(data, offsets)
    if lower:
        data = _lower[data]
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SLICE, "right")), i + 1)
        a, b = starts[i], ends[j - 1]
        if b - a <= SLICE:
            sums = prefix_sums(data[a:b])
            out[i:j] = span_hashes(sums, starts[i:j] - a, ends[i:j] - a)
        else:
            out[i] = _long_hash(data[a:b])
        i = j
    return mix(out), starts, ends, counts


def _long_hash(data: np.ndarray) -> np.uint64:
    total = 0
    for k in range(0, len(data), SLICE):
        sums = prefix_sums(data[k : k + SLICE])
        total += int(sums[-1]) * pow(_BASE, k, 1 << 64)
    return np.uint64(total & _MASK)


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    if len(keys) < width:
        return keys[:0]
    have = 1
    out = keys
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def text_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The column that ``columns`` took apart."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
