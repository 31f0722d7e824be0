"""Sorted runs in levels: flush, merge, tombstones, compaction planning and lookups by key range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.schemas import MUTATIONS, RESETS

# The shape of the level tree.
LEVELS = 7
L0_TRIGGER = 4
L1_BYTES = 10 * 1024 * 1024
GROWTH = 10
TARGET_FILE_BYTES = 2 * 1024 * 1024


def flush(entries: DataFrame, version: list[Column], level: int = 0, run_id: int = 0) -> DataFrame:
    """A run of the newest row of each key of (k, is_tombstone, v), as run entries."""
    newest = entries.groupBy("k").agg(F.max_by(F.struct("is_tombstone", "v"), F.struct(*version)).alias("e"))
    return newest.select(F.lit(level).alias("level"), F.lit(run_id).cast("long").alias("run_id"), "k", "e.is_tombstone", "e.v")


def folded(log: DataFrame) -> DataFrame:
    """(k, is_tombstone, v, open) after the accepted mutations (k, idx, op, v) of a log tail.

    ``open`` keys were only appended to, so what older runs hold comes before ``v``. As in ``fold``, values before a key's last put or delete are dropped before
    they are concatenated.
    """
    writes = log.where(F.col("op").isin(*MUTATIONS)).select("k", "idx", "op", "v")
    ends = writes.groupBy(F.col("k").alias("__k")).agg(F.max(F.when(F.col("op").isin(*RESETS), F.col("idx"))).alias("__reset"), F.max_by("op", "idx").alias("__last"))
    live = writes.join(ends, F.col("k").eqNullSafe(F.col("__k"))).where(F.col("__reset").isNull() | (F.col("idx") >= F.col("__reset")))
    value = live.withColumn("v", F.when(F.col("op") != "delete", F.col("v"))).groupBy("k", "__reset", "__last").agg(F.expr("listagg(v, '') WITHIN GROUP (ORDER BY idx)").alias("v"))
    dead = F.col("__last") == "delete"
    return value.select("k", dead.alias("is_tombstone"), F.when(~dead, F.coalesce("v", F.lit(""))).alias("v"), F.col("__reset").isNull().alias("open"))


def on_base(tail: DataFrame, base: DataFrame) -> DataFrame:
    """(k, is_tombstone, v) of ``folded`` rows, with open keys behind their value (k, v) in ``base``."""
    held = base.select(F.col("k").alias("__k"), F.col("v").alias("__held"))
    joined = tail.join(held, F.col("open") & F.col("k").eqNullSafe(F.col("__k")), "left")
    return joined.select("k", "is_tombstone", F.when(F.col("open"), F.concat(F.coalesce("__held", F.lit("")), "v")).otherwise(F.col("v")).alias("v"))


def write_run(run: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Writes a run in key ranges, sorted, with min/max statistics and bloom filters on the key, so that lookups skip files and row groups."""
    writer = run.repartitionByRange("k").sortWithinPartitions("k").write
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.option("parquet.bloom.filter.enabled#k", "true").parquet(path)


def split_files(run: DataFrame, files: int, prefix: int = 6) -> DataFrame:
    """Run entries with the number of the file, of ``files`` files of about equal rows in key order.

    Ranks in two levels: rows are counted by the first ``prefix`` characters of the key, a running sum over those counts places
    each prefix, and rows are numbered inside it. So no run is sorted as a whole in one task.
    """
    scope = ["level", "run_id"]
    dealt = run.withColumn("__p", F.substring("k", 1, prefix))
    before = Window.partitionBy(*scope).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*scope, "__p").agg(F.count(F.lit(1)).alias("__c"))
    placed = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn("__n", F.sum("__c").over(Window.partitionBy(*scope))).drop("__c")
    nth = F.row_number().over(Window.partitionBy(*scope, "__p").orderBy("k")) - 1
    numbered = dealt.withColumn("__r", nth).join(placed, [*scope, "__p"])
    file = F.floor((F.col("__before") + F.col("__r")) * F.lit(files) / F.col("__n")).cast("int")
    return numbered.select(*run.columns, file.alias("file"))


def manifest(entries: DataFrame) -> DataFrame:
    """(level, run_id, size, smallest, largest) of each run; size in bytes of keys and values."""
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    return entries.groupBy("level", "run_id").agg(F.sum(size.cast("long")).alias("size"), F.min("k").alias("smallest"), F.max("k").alias("largest"))


def age() -> list[Column]:
    """Ascending age of a run: lower levels are newer, and in a level the higher run number."""
    return [F.col("level"), -F.col("run_id")]


def merge(entries: DataFrame) -> DataFrame:
    """The newest entry of each key over all runs, tombstones included: (k, is_tombstone, v, level, run_id).

    One aggregation, combined before the shuffle; no sort of all entries and no window.
    """
    newest = entries.groupBy("k").agg(F.min_by(F.struct("is_tombstone", "v", "level", "run_id"), F.struct(*age())).alias("e"))
    return newest.select("k", "e.is_tombstone", "e.v", "e.level", "e.run_id")


def live(entries: DataFrame) -> DataFrame:
    """(k, v) of the keys whose newest entry is a value."""
    return merge(entries).where(~F.col("is_tombstone")).select("k", "v")


def drop_tombstones(merged: DataFrame, files: DataFrame, out_level: int) -> DataFrame:
    """Merged entries without the tombstones that shadow nothing: no file below ``out_level`` covers their key.

    Tombstones alone take part in the range test. The files' ranges are narrow rows of a manifest; overlapping ranges of a level
    are joined to disjoint stretches first, so each tombstone meets at most one stretch a level.
    """
    deeper = stretches(files.where(F.col("level") > out_level))
    dead = merged.where("is_tombstone")
    shadowing = covering(dead.select("k").distinct(), deeper).select("k").distinct()
    gone = dead.join(shadowing, "k", "left_anti").select("k")
    return merged.join(gone, "k", "left_anti")


def stretches(files: DataFrame) -> DataFrame:
    """Disjoint key ranges (level, smallest, largest) that the files of each level cover."""
    order = Window.partitionBy("level").orderBy("smallest", "largest")
    reach = F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = files.withColumn("__new", F.when(reach.isNull() | (F.col("smallest") > reach), 1).otherwise(0))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("__island", island).groupBy("level", "__island").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest")).drop("__island")


def covering(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of ``keys`` (k) and ``ranges`` (level, smallest, largest) with smallest <= k <= largest.

    A range join. The ranges are manifest rows, one for some megabytes of entries, and disjoint in a level; Spark broadcasts them
    while they are below its own size threshold.
    """
    return ranges.join(keys, F.col("k").between(F.col("smallest"), F.col("largest")))


def lookup_candidates(keys: DataFrame, files: DataFrame) -> DataFrame:
    """(k, level, run_id): the files whose key range holds each key, those that a lookup has to open."""
    return keys.select("k").join(files, F.col("k").between(F.col("smallest"), F.col("largest"))).select("k", "level", "run_id")


def overlaps(files: DataFrame, level: int) -> DataFrame:
    """Pairs of files of a level and the next whose closed key ranges meet: (level, run_id, below_id)."""
    up = files.where(F.col("level") == level).select("level", "run_id", F.col("smallest").alias("s"), F.col("largest").alias("l"))
    down = files.where(F.col("level") == level + 1).select(F.col("run_id").alias("below_id"), "smallest", "largest")
    return up.join(down, (F.col("s") <= F.col("largest")) & (F.col("smallest") <= F.col("l"))).select("level", "run_id", "below_id")


def input_range(files: DataFrame) -> DataFrame:
    """The least key range that holds all files."""
    return files.agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def level_stats(files: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, files, bytes) of every level, empty ones too."""
    every = files.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    held = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return every.join(held, "level", "left").select("level", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def level_budget(level: Column, l1_bytes: int = L1_BYTES, growth: int = GROWTH) -> Column:
    return F.lit(float(l1_bytes)) * F.pow(F.lit(float(growth)), level - 1)


def level_scores(files: DataFrame, levels: int = LEVELS, trigger: int = L0_TRIGGER, l1_bytes: int = L1_BYTES, growth: int = GROWTH) -> DataFrame:
    """(level, score): level 0 by its number of files, deeper ones by bytes against their budget; the bottom level never asks."""
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(trigger))).when(F.col("level") == levels - 1, F.lit(0.0)).otherwise(F.col("bytes") / level_budget(F.col("level"), l1_bytes, growth))
    return level_stats(files, levels).select("level", score.alias("score"))


def pick_level(scores: DataFrame) -> DataFrame:
    """(level, score) of the level to compact: the greatest score of one or more, of equal ones the deeper level."""
    return scores.where("score >= 1").agg(F.max(F.struct("score", "level")).alias("b")).where("b is not null").select("b.level", "b.score")


def pick_file(files: DataFrame, level: int, pointer: str | None) -> DataFrame:
    """The next file of a level in turn: the first that ends behind the pointer, else the first; level 0 takes all its files."""
    mine = files.where(F.col("level") == level)
    if level == 0:
        return mine
    behind = F.lit(True) if pointer is None else F.col("largest") > F.lit(pointer)
    choice = mine.agg(F.coalesce(F.min(F.when(behind, F.struct("smallest", "run_id"))), F.min(F.struct("smallest", "run_id"))).alias("c"))
    return mine.join(F.broadcast(choice), (F.col("smallest") == F.col("c.smallest")) & (F.col("run_id") == F.col("c.run_id"))).drop("c")


def trivial_moves(files: DataFrame, level: int) -> DataFrame:
    """Files of a level (not 0) that meet nothing in the next and so move down by a change of the manifest alone."""
    mine = files.where((F.col("level") == level) & (F.col("level") > 0))
    met = overlaps(files, level).select("run_id").distinct()
    return mine.join(met, "run_id", "left_anti").select(*files.columns)


def moved(files: DataFrame, runs: DataFrame) -> DataFrame:
    """The manifest after trivial moves of ``runs`` (level, run_id)."""
    gone = runs.select("level", "run_id", F.lit(1).alias("__down"))
    return files.join(gone, ["level", "run_id"], "left").select((F.col("level") + F.coalesce("__down", F.lit(0))).cast("int").alias("level"), *(c for c in files.columns if c != "level"))


def compact(entries: DataFrame, files: DataFrame, inputs: Sequence[tuple[int, int]], out_level: int, out_run: int) -> DataFrame:
    """The run that replaces the input runs: newest entries, without tombstones that shadow nothing further down."""
    chosen = F.lit(False)
    for level, run in inputs:
        chosen = chosen | ((F.col("level") == level) & (F.col("run_id") == run))
    merged = merge(entries.where(chosen))
    kept = drop_tombstones(merged, files.where(~chosen), out_level)
    return kept.select(F.lit(out_level).alias("level"), F.lit(out_run).cast("long").alias("run_id"), "k", "is_tombstone", "v")


def recover(entries: DataFrame, log_tail: DataFrame) -> DataFrame:
    """State (k, v) from runs and the accepted mutations behind them: the tail, newer than any run, counts as level -1; appends add to what the runs hold."""
    tail = folded(log_tail)
    asked = tail.where("open").select(F.col("k").alias("__k"))
    base = live(entries.join(asked, F.col("k").eqNullSafe(F.col("__k")), "left_semi"))
    newest = on_base(tail, base).select(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("run_id"), "k", "is_tombstone", "v")
    return live(entries.select("level", "run_id", "k", "is_tombstone", "v").unionByName(newest))
