"""Operation logs: validity, routing, and applying each write once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.hashing import partition_for
from tidelog.operators.ordered import STRETCH, numbered
from tidelog.schemas import MUTATIONS


def key_status(key: Column) -> Column:
    """'invalid' for keys that users may not write: null, empty, or with a leading zero byte; else 'ok'."""
    return F.when(key.isNull() | (key == "") | key.startswith("\0"), F.lit("invalid")).otherwise(F.lit("ok"))


def valid(log: DataFrame) -> DataFrame:
    return log.where(key_status(F.col("k")) == "ok")


def misrouted(log: DataFrame, partitions: int) -> DataFrame:
    """Rows whose partition is not the one that their key hashes to."""
    return log.where(F.col("part") != partition_for(F.col("k"), partitions))


def response_status(key: Column, found: Column, op: Column, routed: Column, led: Column, answered: Column) -> Column:
    """The status of a request: the first rule that applies. Only a get can miss; a null flag counts as false."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(answered), "timeout")
        .when(no(routed), "wrong_partition")
        .when(key_status(key) == "invalid", "invalid")
        .when(no(led), "wrong_leader")
        .when((op == "get") & no(found), "not_found")
        .otherwise("ok")
    )


def with_previous_seq(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Mutations with ``last_seq``, the greatest sequence number of the same (part, client_id) earlier in the log, or 0.

    The running maximum of all rows is that of the accepted ones, because a rejected row is never greater. It is taken in
    stretches of the log: a maximum for each client and stretch (combined before the shuffle), a running maximum over those few rows, and a
    window inside the stretch. So a client with a third of all rows is no single task.
    """
    writes = log.where(F.col("op").isin(*MUTATIONS)).withColumn("__stretch", F.floor(F.col("idx") / stretch))
    scope = ["part", "client_id"]
    earlier = Window.partitionBy(*scope).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = writes.groupBy(*scope, "__stretch").agg(F.max("seq").alias("__top")).withColumn("__before", F.max("__top").over(earlier)).drop("__top")
    inside = Window.partitionBy(*scope, "__stretch").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    near = writes.withColumn("__near", F.max("seq").over(inside))
    keyed = tops.select(*(F.col(c).alias(f"__of_{c}") for c in (*scope, "__stretch")), "__before")
    same = F.lit(True)
    for c in (*scope, "__stretch"):  # a null client, partition or index is a value of its own: no mutation leaves both answers
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    near = near.join(keyed, same).drop(*(f"__of_{c}" for c in (*scope, "__stretch")))
    return near.withColumn("last_seq", F.greatest(F.coalesce("__near", F.lit(0)), F.coalesce("__before", F.lit(0)), F.lit(0))).drop("__near", "__before", "__stretch")


def accepted(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The mutations that apply: those with a sequence number above all earlier ones of their client in the partition."""
    return with_previous_seq(log, stretch).where(F.col("seq") > F.col("last_seq"))


def rejected(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The mutations that are retries or come too late."""
    return with_previous_seq(log, stretch).where(~(F.coalesce("seq", F.lit(0)) > F.col("last_seq")))


def last_seq(log: DataFrame) -> DataFrame:
    """The greatest applied sequence number of each client in each partition."""
    return log.where(F.col("op").isin(*MUTATIONS)).groupBy("part", "client_id").agg(F.max("seq").alias("last_seq"))


def not_applied(log: DataFrame, applied: int) -> DataFrame:
    """What a replay still has to apply; reaches the scan as a range filter."""
    return log.where(F.col("idx") > applied)


def applied_index(log: DataFrame) -> DataFrame:
    """The last index of each partition: no-ops and entries without effect advance it too."""
    return log.groupBy("part").agg(F.max("idx").alias("applied"), F.sum(F.when(F.col("op").isin(*MUTATIONS), 1).otherwise(0)).cast("long").alias("mutations"))


def proposed(log: DataFrame, commands: DataFrame, order: str) -> DataFrame:
    """Commands with the indexes that a leader would give them: behind the last of the log, by ``order`` (a whole number), for each partition."""
    last = log.groupBy("part").agg(F.max("idx").alias("__last"))
    return numbered(commands, ["part"], order, "__n").join(last, "part", "left").withColumn("idx", F.coalesce("__last", F.lit(0)) + F.col("__n")).drop("__n", "__last")
