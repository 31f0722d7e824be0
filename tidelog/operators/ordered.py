"""Looking back along an order without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of one stretch of a log.
STRETCH = 1 << 20


def last_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    """df with ``name``: the last value that is not null among the earlier rows of the same keys, by ``order`` (a whole number) and ``ties``.

    The order is cut into stretches. A window looks back inside the stretch; each stretch's last value, one row after an aggregation
    that combines before the shuffle, is carried over the stretches and joined. So a key with a third of all rows is dealt over as many tasks as it
    has stretches.
    """
    valued = df.withColumn("__value", value).withColumn("__stretch", F.floor(F.col(order) / stretch))
    inside = Window.partitionBy(*keys, "__stretch").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    near = valued.withColumn("__near", F.last("__value", ignorenulls=True).over(inside))
    at = F.struct(order, *ties)
    tops = valued.groupBy(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), F.col("__stretch").alias("__s")).agg(
        F.max_by(F.col("__value"), F.when(F.col("__value").isNotNull(), at)).alias("__top")
    )
    earlier = Window.partitionBy(*(f"__{i}" for i in range(len(keys)))).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("__before", F.last("__top", ignorenulls=True).over(earlier)).drop("__top")
    same = F.col("__stretch") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    joined = near.join(carried, same, "left").withColumn(name, F.coalesce("__near", "__before"))
    return joined.select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], order: str, name: str, ties: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    """df with ``name``: each row's number, from 1, among the rows of the same keys by ``order`` (a whole number) and ``ties``.

    A row_number inside each stretch of the order, plus the rows of the stretches before it: their counts combine before the shuffle and are few.
    """
    dealt = df.withColumn("__stretch", F.floor(F.col(order) / stretch))
    inside = Window.partitionBy(*keys, "__stretch").orderBy(order, *ties)
    counts = dealt.groupBy(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), F.col("__stretch").alias("__s")).agg(F.count(F.lit(1)).alias("__c"))
    earlier = Window.partitionBy(*(f"__{i}" for i in range(len(keys)))).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__before", F.coalesce(F.sum("__c").over(earlier), F.lit(0))).drop("__c")
    same = F.col("__stretch").eqNullSafe(F.col("__s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    near = dealt.withColumn("__near", F.row_number().over(inside))
    return near.join(placed, same).select(*df.columns, (F.col("__near") + F.col("__before")).cast("long").alias(name))
