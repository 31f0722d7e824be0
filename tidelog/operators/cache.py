"""Replays of a byte-bounded cache that evicts what was used longest ago."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class LruCache:
    """Charges by key; a charge above the capacity is not kept longer than the next insertion."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used = capacity, 0
        self.held: OrderedDict[object, int] = OrderedDict()

    def access(self, key: object, charge: int) -> bool:
        """Touches or inserts a key; whether it was there."""
        if key in self.held:
            self.held.move_to_end(key)
            return True
        self.held[key] = charge
        self.used += charge
        while self.used > self.capacity and self.held:
            self.used -= self.held.popitem(last=False)[1]
        return False


def replay(accesses: DataFrame, capacity: int) -> DataFrame:
    """accesses (shard, seq, key, charge) with ``hit``, one cache for each shard; order by seq matters, so a shard is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        cache = LruCache(capacity)
        return pdf.assign(hit=[cache.access(k, int(c)) for k, c in zip(pdf["key"], pdf["charge"], strict=True)])

    rows = accesses.select(F.col("shard").cast("long"), F.col("seq").cast("long"), F.col("key").cast("string"), F.col("charge").cast("long"))
    return rows.groupBy("shard").applyInPandas(run, "shard long, seq long, key string, charge long, hit boolean")


def recency(accesses: DataFrame) -> DataFrame:
    """(shard, key, last_seq, rank): keys by their last access, the newest first."""
    last = accesses.groupBy("shard", "key").agg(F.max("seq").alias("last_seq"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("last_seq"))))
