"""Sharding and replica placement on a consistent-hash ring.

A ring has nodes times virtual nodes points, and a placement partitions times replicas rows: both are configuration, bounded by the
cluster and not by the data, so they are computed by sorted search over the ring's points and broadcast to keys.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import murmur64a, partition_for
from tidelog.schemas import PLACEMENT, RING


class Ring:
    """Points of nodes on a circle of 64-bit hashes; adding or removing a node twice changes nothing."""

    def __init__(self, vnodes: int = 64) -> None:
        self.vnodes = vnodes
        self.owner: dict[int, int] = {}
        self.nodes: set[int] = set()
        self._sorted: list[int] | None = None

    def _points(self, node: int) -> list[int]:
        return [int(h) for h in murmur64a(pa.array([f"node-{node}#{v}" for v in range(self.vnodes)], pa.string()))]

    def add(self, node: int) -> None:
        if node not in self.nodes:
            self.nodes.add(node)
            self.owner.update(dict.fromkeys(self._points(node), node))  # the last writer of a point owns it
            self._sorted = None

    def remove(self, node: int) -> None:
        if node in self.nodes:
            self.nodes.discard(node)
            self.owner = {p: n for p, n in self.owner.items() if n != node}
            self._sorted = None

    def lookup(self, key: str, n: int) -> list[int]:
        """The first n different nodes clockwise from the key's hash, all nodes if there are fewer."""
        if self._sorted is None:
            self._sorted = sorted(self.owner)
        points, found = self._sorted, []
        first = bisect_left(points, int(murmur64a(pa.array([key], pa.string()))[0])) if points else 0
        for step in range(len(points)):
            node = self.owner[points[(first + step) % len(points)]]
            if node not in found:
                found.append(node)
                if len(found) == n:
                    break
        return found if n > 0 else []

    def frame(self, spark: SparkSession) -> DataFrame:
        """(point, node_id), points as unsigned numbers."""
        from decimal import Decimal

        return spark.createDataFrame([(Decimal(p), n) for p, n in sorted(self.owner.items())], RING)


def ring(nodes: list[int], vnodes: int = 64) -> Ring:
    out = Ring(vnodes)
    for n in nodes:
        out.add(n)
    return out


def replicas(nodes: list[int], partitions: int, replication: int = 3, vnodes: int = 64) -> dict[int, list[int]]:
    """Each partition's nodes in order of preference."""
    r = ring(nodes, vnodes)
    return {p: r.lookup(f"partition-{p}", replication) for p in range(partitions)}


def placement(spark: SparkSession, nodes: list[int], partitions: int, replication: int = 3, vnodes: int = 64) -> DataFrame:
    """(part, pos, node_id): one row for each replica."""
    rows = [(p, i, n) for p, held in replicas(nodes, partitions, replication, vnodes).items() for i, n in enumerate(held)]
    return spark.createDataFrame(rows, PLACEMENT)


def partitions_on(placed: DataFrame, node: int) -> DataFrame:
    """The partitions that a node holds."""
    return placed.where(F.col("node_id") == node).select("part").distinct()


def route(keys: DataFrame, placed: DataFrame, partitions: int) -> DataFrame:
    """keys (k) with their partition, and a row for each replica: (k, part, pos, node_id). The placement is configuration, and so broadcast."""
    return keys.withColumn("part", partition_for(F.col("k"), partitions)).join(F.broadcast(placed), "part")


def load(routed: DataFrame) -> DataFrame:
    """(node_id, keys): how many keys' replicas each node holds."""
    return routed.groupBy("node_id").agg(F.count(F.lit(1)).alias("keys"))


def spread(loads: DataFrame) -> DataFrame:
    """The greatest load over the least, and both."""
    return loads.agg(F.max("keys").alias("most"), F.min("keys").alias("least")).select("most", "least", (F.col("most") / F.greatest("least", F.lit(1))).alias("ratio"))


def owners(keys: DataFrame, r: Ring) -> DataFrame:
    """keys (k) with node_id, the first node clockwise: a sorted search in the ring's points for each batch."""
    import numpy as np

    points = np.array(sorted(r.owner), np.uint64)
    nodes = np.array([r.owner[int(p)] for p in points], np.int64)

    @F.arrow_udf("long")
    def find(col: pa.Array) -> pa.Array:
        if not len(points):
            return pa.nulls(len(col), pa.int64())
        return pa.array(nodes[np.searchsorted(points, murmur64a(col)) % len(points)])

    return keys.withColumn("node_id", find(F.col("k")))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(keys, moved, fraction) between two ownerships (k, node_id)."""
    both = before.select("k", F.col("node_id").alias("b")).join(after.select("k", F.col("node_id").alias("a")), "k", "full_outer")
    n = F.count(F.lit(1))
    m = F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1))
    return both.agg(n.alias("keys"), m.cast("long").alias("moved")).withColumn("fraction", F.col("moved") / F.greatest("keys", F.lit(1)))
