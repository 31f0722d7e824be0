"""A lossy network as a deterministic transformation of a message table: loss, delay, partitions, order of delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import numbered

# The lossy setting.
DROP_PERCENT, MAX_DELAY_MS = 10, 25


def dice(seed: int, *cols: Column | str) -> Column:
    """0 to 9,999 by a hash; the same message always falls alike."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(10_000))


def connected(src: Column, dst: Column, groups: Sequence[Sequence[int]], down: Sequence[int] = ()) -> Column:
    """Whether two nodes can talk: both up and in the same group; no groups connect all."""
    up = ~src.isin(*down) & ~dst.isin(*down) if down else F.lit(True)
    if not groups:
        return up
    same = F.lit(False)
    for g in groups:
        same = same | (src.isin(*g) & dst.isin(*g))
    return up & same


def deliver(messages: DataFrame, seed: int = 0, drop_percent: int = DROP_PERCENT, max_delay_ms: int = MAX_DELAY_MS, groups: Sequence[Sequence[int]] = (), down: Sequence[int] = ()) -> DataFrame:
    """Messages (seq, src, dst, sent_ms) with status (lost, cut or delivered) and arrival at_ms."""
    lost = dice(seed, "seq") < drop_percent * 100
    delay = F.floor(dice(seed + 1, "seq") * (max_delay_ms + 1) / 10_000).cast("long")
    status = F.when(~connected(F.col("src"), F.col("dst"), groups, down), "cut").when(lost, "lost").otherwise("delivered")
    return messages.withColumn("status", status).withColumn("at_ms", F.when(F.col("status") == "delivered", F.col("sent_ms") + delay))


def delivery_order(delivered: DataFrame) -> DataFrame:
    """Delivered messages with their position at each receiver, by arrival and then by sending."""
    return numbered(delivered.where("status = 'delivered'"), ["dst"], "at_ms", "position", ("seq",))


def counts(delivered: DataFrame) -> DataFrame:
    return delivered.groupBy("status").agg(F.count(F.lit(1)).alias("messages"))
