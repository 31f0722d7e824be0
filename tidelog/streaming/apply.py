"""Applying a stream of log entries to state: exactly once, in index order, restartable.

Two forms. ``apply_batches`` folds micro-batches into a snapshot with DataFrame operators and swaps it by manifest, for any state size.
``accept_stream`` keeps each client's last sequence number and its out-of-order entries in Structured Streaming state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.oplog import with_previous_seq
from tidelog.schemas import MUTATIONS
from tidelog.sources.snapshots import Snapshots

ACCEPTED = "idx LONG, part INT, client_id LONG, seq LONG, op STRING, k STRING, v STRING"


def advance(state: DataFrame, last_seq: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State (k, v, version) and last_seq (part, client_id, last_seq) after a batch of entries, and the accepted entries.

    The batch goes through the exactly-once rule with what each client had applied before, then through one aggregation for each touched key; other keys pass as they are.
    """
    before = last_seq.select("part", "client_id", F.col("last_seq").alias("__held"))
    ranked = with_previous_seq(batch).join(before, ["part", "client_id"], "left")
    new = ranked.where(F.col("seq") > F.greatest("last_seq", F.coalesce("__held", F.lit(0)))).select("idx", "part", "client_id", "seq", "op", "k", "v")
    tops = new.groupBy("part", "client_id").agg(F.max("seq").alias("last_seq"))
    seqs = last_seq.unionByName(tops).groupBy("part", "client_id").agg(F.max("last_seq").alias("last_seq"))
    resets = new.where("op <> 'append'").groupBy("k").agg(F.max_by(F.struct("idx", "op"), "idx").alias("r"))
    tail = new.join(resets, "k", "left").where("r is null or idx >= r.idx")
    touched = tail.groupBy("k").agg(
        F.expr("listagg(if(op = 'delete', null, v), '') WITHIN GROUP (ORDER BY idx)").alias("added"),
        F.max("r").alias("r"),
        F.max("idx").alias("at"),
        F.max(F.when(F.col("op") != "delete", F.col("idx"))).alias("written"),
    )
    both = state.join(touched, "k", "full_outer")
    value = F.when(F.col("at").isNull(), F.col("v")).when(F.col("r").isNull(), F.concat(F.coalesce("v", F.lit("")), F.coalesce("added", F.lit("")))).otherwise(F.coalesce("added", F.lit("")))
    gone = F.col("at").isNotNull() & F.col("written").isNull()
    after = both.where(~gone).select("k", value.alias("v"), F.coalesce("at", "version").alias("version"))
    return after, seqs, new


def apply_batches(entries: DataFrame, store: Snapshots, checkpoint: str, trigger: dict[str, Any] | None = None):  # noqa: ANN201
    """Starts a query that folds each micro-batch of ``entries`` into the store; a batch that was already committed changes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.committed(spark) >= batch_id:
            return
        state, seqs = store.load(spark)
        after, last, _ = advance(state, seqs, batch.where(F.col("op").isin(*MUTATIONS)))
        store.commit(spark, batch_id, after, last)

    return entries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Accept(StatefulProcessor):
    """Passes a client's writes on in order of idx, each sequence number above the last; waits for the indexes that ``width`` says may still come."""

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq LONG")
        self.held = handle.getValueState("held", "rows STRING")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        last = self.last.get()[0] if self.last.exists() else 0
        waiting = json.loads(self.held.get()[0]) if self.held.exists() else []
        for pdf in rows:
            waiting += pdf[["idx", "seq", "op", "k", "v"]].astype(object).where(pdf.notna(), None).values.tolist()
        waiting.sort()
        top = waiting[-1][0] - self.width if waiting else 0
        ready, late = [w for w in waiting if w[0] <= top], [w for w in waiting if w[0] > top]
        out = []
        for idx, seq, op, k, v in ready:
            if seq > last:
                last = seq
                out.append((idx, int(key[0]), int(key[1]), seq, op, k, v))
        self.last.update((last,))
        self.held.update((json.dumps(late),))
        if out:
            yield pd.DataFrame(out, columns=["idx", "part", "client_id", "seq", "op", "k", "v"])

    def close(self) -> None:
        pass


def accept_stream(entries: DataFrame, width: int = 0) -> DataFrame:
    """The accepted mutations of a stream of log entries. Needs the RocksDB state store.

    ``width`` is how far, in log indexes, entries of a client may arrive out of order; entries within that distance of the newest wait in state.
    """
    writes = entries.where(F.col("op").isin(*MUTATIONS)).select("part", "client_id", "idx", "seq", "op", "k", "v")
    return writes.groupBy("part", "client_id").transformWithStateInPandas(_Accept(width), ACCEPTED, "Append", "None")


def windowed_latency(events: DataFrame, at: str, value: str, window: str, late: str) -> DataFrame:
    """Counts, mean and greatest value of event-time windows of a stream; ``at`` is cast to a timestamp, since watermarks need one."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", window)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most")).select("window.start", "window.end", "n", "mean", "most")




def replay(spark: SparkSession, batches: list[DataFrame], store: Snapshots, done: Callable[[int], None] = lambda _: None) -> None:
    """Applies batch frames in order, as a restarted query would: those that were committed are skipped."""
    for i, batch in enumerate(batches):
        if store.committed(spark) < i:
            state, seqs = store.load(spark)
            after, last, _ = advance(state, seqs, batch.where(F.col("op").isin(*MUTATIONS)))
            store.commit(spark, i, after, last)
        done(i)
