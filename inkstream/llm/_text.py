"""Vectorised word kernels over Arrow string columns.

All functions see the UTF-8 bytes of whole texts.  A word is a maximal run of
bytes other than space and 0x09-0x0D, which is the same as the code-point class
``[^\\x20\\x09-\\x0D]+`` because no multi-byte sequence contains those bytes.
Nothing here is per word in Python: a chunk of a few megabytes of text becomes
a handful of numpy arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is worked on alone.
CHUNK_BYTES = (1 << 20) - 64

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, so it has an inverse mod 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_BASE = np.uint64(0xD1342543DE82EF93)
_WORD_INV = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection) over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def trim() -> None:
    """Give freed memory back to the system: a worker process waits for its next task, beside the JVM's and others' work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def rows(batches, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` rows, for columns of wide values."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    trim()


def chunks(batches, text: str = "text", limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text each, with bytes and offsets."""
    limit = limit or CHUNK_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_buffer(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
            first = last
    trim()


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word (n+1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    is_word = ~_IS_SEP[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(is_word[:-1], out=before[1:])
    starts = np.flatnonzero(is_word & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(is_word[1:], out=after[:-1])
    ends = np.flatnonzero(is_word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal for equal words wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, at its first word; len - width + 1 of them."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(_WORD_INV, len(words) + 1)[:n] + np.uint64(width))


def owner(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text, from the texts' first words (n+1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
