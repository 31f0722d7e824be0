"""Client histories: generating them, and checking that each key's operations are linearizable."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def apply(state: str, op: str, value: str, output: str) -> tuple[bool, str]:
    """Whether a register in ``state`` may answer so, and its next state. An absent value reads as ''."""
    if op == "get":
        return output == state, state
    if op == "put":
        return True, value
    if op == "append":
        return True, state + value
    if op == "delete":
        return True, ""
    raise ValueError(f"unknown operation {op}")


def check_key(ops: list[tuple[str, str, str, int, int]], steps: int | None = None) -> str:
    """'ok' or 'violation' for one key's completed operations (op, input, output, call, return); 'unknown' only after ``steps`` search steps, where that many are set.

    Depth-first search for an order of the operations that a register allows and that keeps apart operations of which one returned before the other
    was called. At each point any operation may be next that was called no later than the earliest return among those that are left. States that were reached with the same
    set of operations done are not searched again. At equal times a call counts as before a return.
    """
    n = len(ops)
    by_return = sorted(range(n), key=lambda i: (ops[i][4], i))
    by_call = sorted(range(n), key=lambda i: (ops[i][3], i))
    seen: set[tuple[int, str]] = set()

    def choices(done: int) -> Iterator[int]:
        bound = next(ops[i][4] for i in by_return if not done >> i & 1)
        for i in by_call:
            if ops[i][3] > bound:
                return
            if not done >> i & 1:
                yield i

    full, done, state = (1 << n) - 1, 0, ""
    if not n:
        return "ok"
    stack = [(done, state, choices(done))]
    while stack:
        done, state, rest = stack[-1]
        i = next(rest, None)
        if i is None:
            stack.pop()
            continue
        allowed, after = apply(state, ops[i][0], ops[i][1], ops[i][2])
        if not allowed:
            continue
        now = done | 1 << i
        if now == full:
            return "ok"
        if (now, after) in seen:
            continue
        if steps is not None:
            steps -= 1
            if steps < 0:
                return "unknown"
        seen.add((now, after))
        stack.append((now, after, choices(now)))
    return "violation"


def check(history: DataFrame, steps: int | None = None) -> DataFrame:
    """(k, ops, verdict) of each key. Keys are independent, so each is one group of a grouped map."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["call_ns", "ret_ns", "client"], kind="stable")
        ops = list(zip(pdf["op"], pdf["input"].fillna(""), pdf["output"].fillna(""), pdf["call_ns"].tolist(), pdf["ret_ns"].tolist(), strict=True))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "ops": [len(ops)], "verdict": [check_key(ops, steps)]})

    return history.groupBy("k").applyInPandas(run, "k string, ops long, verdict string")


def summary(checked: DataFrame) -> DataFrame:
    """(ok, bad_key, unknown_keys): ok is false if a key is violated, null if none is but some are unknown; bad_key is the first violated key in byte order."""
    bad, unknown = F.col("verdict") == "violation", F.count(F.when(F.col("verdict") == "unknown", 1))
    ok = F.when(F.count(F.when(bad, 1)) > 0, False).when(unknown == 0, True)
    return checked.agg(ok.alias("ok"), F.min(F.when(bad, F.col("k"))).alias("bad_key"), unknown.alias("unknown_keys"))


def stats(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("ops"), F.count_distinct("k").alias("keys"), F.count_distinct("client").alias("clients"))


def workload(spark: SparkSession, clients: int, ops: int, keys: int, seed: int = 0) -> DataFrame:
    """Requests (client, n, op, k, input): 40 % get, 20 % put, 35 % append, 5 % delete, with values that occur once.

    A range and hashes of it, so any part of it can be made again anywhere.
    """
    dice = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100))
    client, n = F.pmod("id", F.lit(clients)).cast("int"), F.floor(F.col("id") / clients).cast("long")
    op = F.when(dice < 40, "get").when(dice < 60, "put").when(dice < 95, "append").otherwise("delete")
    key = F.concat(F.lit("key"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(keys)).cast("string"))
    rows = spark.range(clients * ops).select(client.alias("client"), n.alias("n"), op.alias("op"), key.alias("k"))
    value = F.concat(F.when(F.col("op") == "put", "p").otherwise("a"), F.col("client").cast("string"), F.lit("."), F.col("n").cast("string"), F.lit(";"))
    return rows.withColumn("input", F.when(F.col("op").isin("put", "append"), value).otherwise(""))


def executed(requests: DataFrame, length_ns: int = 1000) -> DataFrame:
    """A history of ``requests`` that a correct store could have given, with overlapping calls.

    Requests take effect in the order of (n, client) for each key; each spans its moment. What a get returns is a fold of its key's
    earlier requests, carried along the key's order as a list of values, so it is for small checking workloads.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("k").orderBy("n", "client")
    at = F.row_number().over(order).cast("long") * F.lit(length_ns)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    past = F.collect_list(F.struct("op", "input")).over(upto)
    state = F.aggregate(past, F.lit(""), lambda s, x: F.when(x["op"] == "put", x["input"]).when(x["op"] == "append", F.concat(s, x["input"])).when(x["op"] == "delete", F.lit("")).otherwise(s))
    jitter = F.pmod(F.xxhash64("k", "n", "client"), F.lit(length_ns * 2))
    done = requests.withColumn("at", at).withColumn("output", F.when(F.col("op") == "get", state).otherwise(F.lit("")))
    return done.select("client", "op", "k", "input", "output", (F.col("at") - jitter).alias("call_ns"), (F.col("at") + jitter).alias("ret_ns"))
