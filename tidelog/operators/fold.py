"""From ordered logs to key-value state: the fold, reads at a position, point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import STRETCH, last_before
from tidelog.schemas import MUTATIONS, RESETS


def fold(log: DataFrame) -> DataFrame:
    """(k, v, version) after the accepted mutations ``log`` (k, idx, op, v), in index order.

    Only what follows a key's last put or delete matters. Its index is a maximum, combined before the shuffle; the second pass
    keeps the rows from there on and concatenates them, so neither a running window nor superseded values are carried along.
    A put sets, an append adds to what is there or creates, a delete removes; version is the index of the key's last mutation.
    """
    writes = log.where(F.col("op").isin(*MUTATIONS)).select("k", "idx", "op", "v")
    resets = writes.where(F.col("op").isin(*RESETS)).groupBy(F.col("k").alias("__k")).agg(F.max("idx").alias("__reset"))
    live = writes.join(resets, F.col("k").eqNullSafe(F.col("__k")), "left").where(F.col("__reset").isNull() | (F.col("idx") >= F.col("__reset")))
    values = live.where(F.col("op") != "delete")
    return values.groupBy("k").agg(F.expr("listagg(v, '') WITHIN GROUP (ORDER BY idx)").alias("v"), F.max("idx").alias("version")).select("k", F.coalesce("v", F.lit("")).alias("v"), "version")


def as_of(log: DataFrame, idx: int) -> DataFrame:
    """The state after the mutations up to an index; the bound reaches the scan."""
    return fold(log.where(F.col("idx") <= idx))


def get(state: DataFrame, key: str) -> DataFrame:
    """One key's row, or none."""
    return state.where(F.col("k") == F.lit(key))


def multi_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """(k, v, status) for each row of ``keys``: a missing key has a null value and not_found, an empty value is found."""
    held = state.select("k", "v", F.lit(True).alias("__found"))
    return keys.select("k").join(held, "k", "left").select("k", "v", F.when(F.col("__found"), "ok").otherwise("not_found").alias("status"))


def read_versions(log: DataFrame, reads: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """For reads (read_id, k, read_idx), the last mutation of the key at or before read_idx: (read_id, k, read_idx, version, op).

    Log and reads form one sequence for each key, and the last mutation is carried forward, stretch by stretch; no read is paired with more than one row.
    """
    writes = log.where(F.col("op").isin(*MUTATIONS)).select("k", F.col("idx").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("read_id"), F.struct("idx", "op").alias("w"))
    asks = reads.select("k", F.col("read_idx").alias("at"), F.lit(1).alias("side"), "read_id", F.lit(None).cast(writes.schema["w"].dataType).alias("w"))
    carried = last_before(writes.union(asks), ["k"], "at", F.col("w"), "last", ("side", "read_id"), stretch).where(F.col("side") == 1)
    return carried.select("read_id", "k", F.col("at").alias("read_idx"), F.col("last.idx").alias("version"), F.col("last.op").alias("op"))


def last_write(entries: DataFrame, key: str, version: list[Column], columns: list[str]) -> DataFrame:
    """The newest row of each key, tombstones included; one aggregation that combines before the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct(*version))
    return entries.groupBy(key).agg(newest.alias("__e")).select(key, "__e.*")


def memtable_bytes(entries: DataFrame, key: str, value: str, overhead: int = 64) -> DataFrame:
    """Approximate bytes of a table of distinct keys: key, value and a fixed overhead each."""
    size = F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + overhead
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.sum(size.cast("long")).alias("bytes"))


def differences(model: DataFrame, store: DataFrame) -> DataFrame:
    """Keys on which two states differ, with both values; null stands for absent."""
    a = model.select("k", F.struct(F.col("v")).alias("a"))
    b = store.select("k", F.struct(F.col("v")).alias("b"))
    return a.join(b, "k", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("k", F.col("a.v").alias("expected"), F.col("b.v").alias("actual"))
