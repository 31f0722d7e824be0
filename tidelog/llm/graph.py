"""Connected components on Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import keep


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # kept, so that the join after it is of plain exchanges, whose hubs Spark can split
    least = keep(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("low")).select("c", F.least("c", "low").alias("m")))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = keep(down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")))
    out = down.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("a"), "m"), F.struct(F.col("u").alias("a"), "m"))).alias("e"))
    return out.select(F.col("e.a").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Every node points once, and no node that is pointed to points on."""
    n, once = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    ends = edges.select(F.col("u").alias("w"))
    return n == once and edges.join(ends, F.col("v") == F.col("w"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, comp) for every node that has a link, comp the smallest node reached.

    Each round is two shuffled joins over the shrinking edge list, kept in the shared folder; the
    number of rounds grows with the logarithm of the longest path. Only counts
    reach the driver. Null ends and self-links are ignored; no links give no rows.
    """
    now = keep(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(now):
        now = keep(_small(_large(now)))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
