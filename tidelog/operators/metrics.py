"""Throughput, latency and ratio figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def throughput(ops: Column, nbytes: Column, seconds: Column) -> dict[str, Column]:
    """Operations a second, microseconds an operation and megabytes a second; null where there is nothing to divide by."""
    return {
        "ops_per_s": F.try_divide(ops, seconds),
        "us_per_op": F.try_divide(seconds * 1_000_000, ops),
        "mb_per_s": F.try_divide(nbytes / F.lit(1048576.0), seconds),
    }


def order_statistics(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics at index floor(share * (n - 1)) of the sorted values of each group; no interpolation.

    Equal values are counted first, so what a group sorts are its different values and not its rows; a hot group
    with many different values still sorts in one task of a spilling window, never in one list.
    """
    from pyspark.sql.window import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    reach = counted.withColumn("__upto", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    picks = []
    for name, share in shares.items():
        at = F.floor(F.lit(share) * (F.col("__n") - 1))
        picks.append(F.min(F.when(F.col("__upto") > at, F.col(value))).alias(name))
    return reach.groupBy(*by).agg(F.max("__n").alias("n"), *picks)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 if the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def write_amplification(compacted: Column, user: Column) -> Column:
    """Bytes that compactions wrote for each byte that users wrote."""
    return ratio(compacted, user)


def mean_by(df: DataFrame, kind: Column, value: Column) -> DataFrame:
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
