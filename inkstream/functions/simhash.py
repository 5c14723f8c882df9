"""64-bit SimHash: FNV-1a over token shingles in Arrow batches, folded bit by bit.

Tokens come from the JVM as arrays; a batch's token bytes are one buffer, and all
shingles of a chunk are hashed together, byte position by byte position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.text import _col, tokens_raw

WIDTH = 3
BANDS = 4
BAND_BITS = 16
OFFSET = np.uint64(0xCBF29CE484222325)
PRIME = np.uint64(0x100000001B3)
#: Tokens hashed at once.
CHUNK_TOKENS = 200_000


def _feed(h: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Continue FNV-1a states over one token each."""
    live = np.flatnonzero(sizes > 0)
    k = 0
    while len(live):
        h[live] = (h[live] ^ data[starts[live] + k].astype(np.uint64)) * PRIME
        k += 1
        live = live[sizes[live] > k]
    return h


def fingerprints(data: np.ndarray, offs: np.ndarray, first: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """SimHash of each text; ``first`` (n+1) says at which token a text starts."""
    starts, sizes, n = offs[:-1].astype(np.int64), np.diff(offs).astype(np.int64), len(first) - 1
    counts = np.diff(first)
    own = np.repeat(np.arange(n), counts)
    place = np.arange(len(own)) - np.repeat(first[:-1], counts)
    short = counts[own] < width
    head = np.flatnonzero(short | (place <= counts[own] - width))
    h = _feed(np.full(len(head), OFFSET), data, starts[head], sizes[head])
    long_ = np.flatnonzero(~short[head])
    for i in range(1, width):
        h[long_] = (h[long_] ^ np.uint64(0x20)) * PRIME
        h[long_] = _feed(h[long_], data, starts[head[long_] + i], sizes[head[long_] + i])
    of = own[head]
    total = np.bincount(of, minlength=n)
    out = np.zeros(n, np.uint64)
    for bit in range(64):
        ones = np.bincount(of, ((h >> np.uint64(bit)) & np.uint64(1)).astype(np.float64), n)
        out |= (2 * ones > total).astype(np.uint64) << np.uint64(bit)
    return out


def _hash_batches(width: int, extra: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(extra)
            flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            flat = flat.cast(pa.large_string())
            offs = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) and flat.buffers()[2] is not None else np.zeros(0, np.uint8)
            out, i = [], 0
            while i < batch.num_rows:
                j = min(max(int(np.searchsorted(bounds, bounds[i] + CHUNK_TOKENS, "right")) - 1, i + 1), batch.num_rows)
                out.append(fingerprints(data, offs[bounds[i] : bounds[j] + 1], bounds[i : j + 1] - bounds[i], width))
                i = j
            values = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(extra)), pa.array(values.view(np.int64))], names=[*batch.schema.names[:extra], "simhash"])

    return run


def with_simhash(df: DataFrame, text: Column | str, keep: list[str], width: int = WIDTH) -> DataFrame:
    """``keep`` columns and ``simhash`` (bits of a signed long; 0 for no tokens) of a text column."""
    tokens = df.select(*keep, tokens_raw(text).alias("__tokens"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields[:-1])
    return tokens.mapInArrow(_hash_batches(width, len(keep)), f"{fields}, simhash long")


def hamming(a, b) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def is_near_duplicate(a, b, distance: int = 3) -> Column:
    return (_col(a) != 0) & (_col(b) != 0) & (hamming(a, b) <= distance)


def band_sizes(distance: int = 3) -> list[int]:
    """Widths of distance + 1 bands: two fingerprints that close agree on one of them."""
    n = max(BANDS, distance + 1)
    return [64 // n + (i >= n - 64 % n) for i in range(n)]


def bands(h, distance: int = 3) -> Column:
    """array of (band, value) of a fingerprint; exact for ``distance`` by pigeonhole."""
    out, at = [], 0
    for i, bits in enumerate(band_sizes(distance)):
        value = F.shiftrightunsigned(_col(h), at).bitwiseAND(F.lit((1 << bits) - 1))
        out.append(F.struct(F.lit(i).alias("band"), value.cast("long").alias("value")))
        at += bits
    return F.array(*out)
