"""Bloom filters over keys, bit-exact and mergeable.

A filter is built by partial filters of row batches that are joined by OR, so a large run needs no task that sees all its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import BLOOM_SEED, murmur64a

BITS_PER_KEY = 10


# 0.69 and the bounds 1 and 30 of the probe count, and the turn by 33 of the step.
def probes(bits_per_key: int) -> int:
    """Probes for a filter of so many bits a key: about ln 2 times the bits, between 1 and 30."""
    return max(1, min(30, int(bits_per_key * 0.69)))


def probe_count(bits_per_key: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(30), (bits_per_key * F.lit(0.69)).cast("int")))


def size_bytes(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return (max(64, keys * bits_per_key) + 7) // 8


def positions(keys: pa.Array, bits: int, k: int) -> np.ndarray:
    """(keys, k) bit positions by double hashing; the step is the hash turned right by 33."""
    h = murmur64a(keys, BLOOM_SEED)
    step = (h >> np.uint64(33)) | (h << np.uint64(31))
    return ((h[:, None] + step[:, None] * np.arange(k, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def fill_into(total: np.ndarray, keys: pa.Array, k: int) -> None:
    """Sets the keys' bits in a filter's bytes."""
    at = positions(keys, len(total) * 8, k).reshape(-1)
    np.bitwise_or.at(total, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def fill(keys: pa.Array, size: int, k: int) -> bytes:
    """A filter of ``size`` bytes over the keys."""
    total = np.zeros(size, np.uint8)
    fill_into(total, keys, k)
    return total.tobytes()


def may_contain(filter_: bytes, keys: pa.Array, k: int) -> np.ndarray:
    """Whether each key may be in the filter; an empty filter rules nothing out."""
    if not filter_:
        return np.ones(len(keys), bool)
    bits = np.frombuffer(filter_, np.uint8)
    at = positions(keys, 8 * len(bits), k)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)


def build(keys: DataFrame, column: str, n: int, bits_per_key: int = BITS_PER_KEY) -> bytes:
    """The filter over all keys of a column, for ``n`` keys; its size is fixed by n, and partial filters join on the executors."""
    size, k = size_bytes(n, bits_per_key), probes(bits_per_key)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint8)
        for b in batches:
            fill_into(total, b.column(0), k)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["bits"])

    def join(rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint8)
        for x in rows["bits"]:
            total |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table([pa.array([total.tobytes()], pa.binary())], ["bits"])

    rows = keys.select(F.col(column).cast("binary").alias("k")).mapInArrow(part, "bits binary")
    # two levels: no task joins more than a few dozen partial filters of a large cluster
    level = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(32)).alias("g")).applyInArrow(join, "bits binary")
    made = level.groupBy(F.lit(0).alias("g")).applyInArrow(join, "bits binary").first()
    return bytes(made.bits) if made else bytes(size)


def contains(filter_: bytes, key: Column, bits_per_key: int = BITS_PER_KEY) -> Column:
    """Whether the filter may hold a key. The filter goes to the executors once, as a broadcast, not with every task."""
    k, held = probes(bits_per_key), SparkSession.active().sparkContext.broadcast(filter_)

    @F.arrow_udf("boolean")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(may_contain(held.value, col, k))

    return run(key.cast("binary"))
