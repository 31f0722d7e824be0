"""A store of sorted runs in levels: flush, compaction, lookups and recovery as jobs, with a manifest swapped last.

The manifest lists runs with their level, number, bytes and key range; keys are written as hexadecimal text. It holds a row for each run, some
megabytes or more of data each, and is read on the driver; entries never are.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import runs
from tidelog.schemas import MANIFEST, RUN_ENTRY
from tidelog.sources.files import Manifests

FEW = 10


def encode_key(key: str) -> str:
    return "k" + key.encode().hex()


def decode_key(text: str) -> str:
    if not text.startswith("k"):
        raise ValueError(f"{text} is no key of a manifest")
    return bytes.fromhex(text[1:]).decode()


class RunStore:
    def __init__(self, path: str, trigger: int = runs.L0_TRIGGER, l1_bytes: int = runs.L1_BYTES, growth: int = runs.GROWTH, levels: int = runs.LEVELS) -> None:
        self.path, self.manifests = path.rstrip("/"), Manifests(path)
        self.shape = {"trigger": trigger, "l1_bytes": l1_bytes, "growth": growth, "levels": levels}

    def _state(self, spark: SparkSession) -> tuple[int, dict[str, Any]]:
        return self.manifests.newest(spark) or (-1, {"runs": [], "next": 0, "pointers": {}})

    def files(self, spark: SparkSession) -> DataFrame:
        """The manifest as (level, run_id, size, smallest, largest)."""
        listed = self._state(spark)[1]["runs"]
        return spark.createDataFrame([(r["level"], r["run_id"], r["size"], decode_key(r["smallest"]), decode_key(r["largest"])) for r in listed], MANIFEST)

    def entries(self, spark: SparkSession, chosen: list[dict[str, Any]] | None = None) -> DataFrame:
        """Run entries of all runs or of the chosen ones; level and number come from the manifest, so a moved run needs no rewrite."""
        listed = self._state(spark)[1]["runs"] if chosen is None else chosen
        out = spark.createDataFrame([], RUN_ENTRY)
        for level in sorted({(r["level"], r["run_id"]) for r in listed}):
            folder = next(r["folder"] for r in listed if (r["level"], r["run_id"]) == level)
            one = spark.read.schema("k STRING, is_tombstone BOOLEAN, v STRING").parquet(f"{self.path}/{folder}")
            out = out.unionByName(one.select(F.lit(level[0]).alias("level"), F.lit(level[1]).cast("long").alias("run_id"), "k", "is_tombstone", "v"))
        return out

    def _write(self, spark: SparkSession, run: DataFrame, level: int, number: int) -> list[dict[str, Any]]:
        folder = f"{number:06d}-{uuid.uuid4().hex}"
        runs.write_run(run.select("k", "is_tombstone", "v"), f"{self.path}/{folder}")
        back = spark.read.schema("k STRING, is_tombstone BOOLEAN, v STRING").parquet(f"{self.path}/{folder}")
        listed = runs.manifest(back.withColumns({"level": F.lit(level), "run_id": F.lit(number).cast("long")})).collect()  # one row
        return [{"level": level, "run_id": number, "folder": folder, "size": r["size"], "smallest": encode_key(r.smallest), "largest": encode_key(r.largest)} for r in listed]

    def flush(self, spark: SparkSession, log: DataFrame) -> None:
        """A new run of level 0 from accepted mutations (idx, op, k, v). Keys that were only appended to get what the store holds before their appends."""
        at, state = self._state(spark)
        tail = runs.folded(log)
        made = self._write(spark, runs.on_base(tail, self.get(spark, tail.where("open").select("k"))), 0, state["next"])
        self.manifests.commit(spark, at + 1, {**state, "runs": state["runs"] + made, "next": state["next"] + 1})

    def compact(self, spark: SparkSession) -> tuple[int, str] | None:
        """One compaction, if a level asks for it: (level, 'move' or 'merge'); None if none does."""
        at, state = self._state(spark)
        files = self.files(spark)
        pick = runs.pick_level(runs.level_scores(files, **self.shape)).first()
        if pick is None:
            return None
        level = pick.level
        pointer = state["pointers"].get(str(level))
        inputs = runs.pick_file(files, level, decode_key(pointer) if pointer else None).collect()
        span = runs.input_range(spark.createDataFrame(inputs, MANIFEST)).first()
        below = files.where((F.col("level") == level + 1) & (F.col("smallest") <= span.largest) & (F.col("largest") >= span.smallest)).collect()
        taken = {(r.level, r.run_id) for r in [*inputs, *below]}
        chosen = [r for r in state["runs"] if (r["level"], r["run_id"]) in taken]
        rest = [r for r in state["runs"] if (r["level"], r["run_id"]) not in taken]
        pointers = {**state["pointers"], str(level): encode_key(span.largest)}
        if level > 0 and len(inputs) == 1 and not below:
            made, how, following = [{**chosen[0], "level": level + 1}], "move", state["next"]
        else:
            others = files.where(~F.struct("level", "run_id").isin(*(F.struct(F.lit(a), F.lit(b).cast("long")) for a, b in taken)))
            merged = runs.drop_tombstones(runs.merge(self.entries(spark, chosen)), others, level + 1)
            made, how, following = self._write(spark, merged, level + 1, state["next"]), "merge", state["next"] + 1
        self.manifests.commit(spark, at + 1, {"runs": rest + made, "next": following, "pointers": pointers})
        return level, how

    def get(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """(k, v) of the keys that are held; only runs whose key range meets that of the keys are read.

        Up to ``FEW`` keys go to the scan as literals, so that key ranges and bloom filters of the files skip row groups; more are a semi-join.
        """
        few = [r.k for r in keys.select("k").where("k is not null").distinct().limit(FEW + 1).collect()]
        span = keys.agg(F.min("k").alias("a"), F.max("k").alias("z")).first()
        listed = [r for r in self._state(spark)[1]["runs"] if span.a is not None and decode_key(r["smallest"]) <= span.z and decode_key(r["largest"]) >= span.a]
        if len(few) <= FEW:
            return runs.live(self.entries(spark, listed).where(F.col("k").isin(few)))
        return runs.live(self.entries(spark, listed).join(keys.select("k").distinct(), "k", "left_semi"))

    def state(self, spark: SparkSession, tail: DataFrame | None = None) -> DataFrame:
        """(k, v) of everything, with the mutations of a log tail on top."""
        return runs.live(self.entries(spark)) if tail is None else runs.recover(self.entries(spark), tail)
