"""64-bit hashing of byte strings, bit-exact with MurmurHash64A, and what is built on it.

Spark has no such function (its ``hash`` is 32 bits wide and ``xxhash64`` another function), and ANSI arithmetic raises on
overflow, so these are Arrow functions over numpy words of 64 bits. Keys of a batch are hashed together, eight bytes of every key a step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier and shift of MurmurHash64A, and the seeds in use.
MULTIPLIER = 0xC6A4A7935BD1E995
SHIFT = 47
DEFAULT_SEED = 0x9747B28C
PARTITION_SEED = 0x5EED
BLOOM_SEED = 0xB10F11E7

_M, _R = np.uint64(MULTIPLIER), np.uint64(SHIFT)


def _stir(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    k = k * _M
    return (h ^ ((k ^ (k >> _R)) * _M)) * _M


def murmur64a(keys: pa.Array, seed: int = DEFAULT_SEED) -> np.ndarray:
    """Unsigned hashes of a binary or string array; null hashes like the empty key."""
    col = keys.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    start, size = off[:-1], np.diff(off)
    h = np.uint64(seed) ^ (size.astype(np.uint64) * _M)

    def words(who: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(eight[at[who]]).view("<u8").ravel()

    for step in range(int(size.max(initial=0)) // 8):
        who = np.flatnonzero(size >= 8 * (step + 1))
        h[who] = _stir(h[who], words(who, start + 8 * step))
    rest = np.flatnonzero(size % 8)
    if len(rest):
        keep = (np.uint64(1) << (np.uint64(8) * (size[rest] % 8).astype(np.uint64))) - np.uint64(1)
        h[rest] = (h[rest] ^ (words(rest, start + size // 8 * 8) & keep)) * _M
    h = (h ^ (h >> _R)) * _M
    return h ^ (h >> _R)


def hash64(key: Column, seed: int = DEFAULT_SEED) -> Column:
    """The hash as a long with the same 64 bits; null for a null key."""

    @F.arrow_udf("long")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(murmur64a(col, seed).view(np.int64), mask=np.asarray(col.is_null()))

    return run(key)


def unsigned(h: Column) -> Column:
    """A long's 64 bits as the unsigned number they stand for."""
    return h.cast("decimal(20,0)") + F.when(h < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def partition_for(key: Column, partitions: int) -> Column:
    """The shard of a key: its hash modulo the number of partitions, unsigned."""

    @F.arrow_udf("int")
    def run(col: pa.Array) -> pa.Array:
        part = murmur64a(col, PARTITION_SEED) % np.uint64(partitions)
        return pa.array(part.astype(np.int32), mask=np.asarray(col.is_null()))

    return run(key)
