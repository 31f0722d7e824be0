"""Folds, exactly-once, reads, runs and recovery, against plain models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import fold, oplog, runs
from tidelog.operators.ordered import last_before, numbered
from tidelog.schemas import OP_LOG, RUN_ENTRY


def log_of(spark, rows):
    """Rows (op, k, v) of one client, in order."""
    full = [(i + 1, 1, 0, 1, i + 1, op, k, v) for i, (op, k, v) in enumerate(rows)]
    return spark.createDataFrame(full, OP_LOG)


def model(rows):
    state: dict[str, str] = {}
    for op, k, v in rows:
        if op == "put":
            state[k] = v
        elif op == "append":
            state[k] = state.get(k, "") + v
        elif op == "delete":
            state.pop(k, None)
    return state


def held(df):
    return {r.k: r.v for r in df.collect()}


def test_basics(spark):
    rows = [("put", "x", "1"), ("append", "x", "23"), ("append", "new", "n"), ("put", "y", ""), ("put", "z", "1"), ("delete", "z", None), ("delete", "never", None), ("get", "x", None)]
    state = fold.fold(oplog.accepted(log_of(spark, rows)))
    assert held(state) == {"x": "123", "new": "n", "y": ""}
    got = fold.multi_get(spark.createDataFrame([("x",), ("y",), ("z",)], "k string"), state)
    assert {r.k: (r.v, r.status) for r in got.collect()} == {"x": ("123", "ok"), "y": ("", "ok"), "z": (None, "not_found")}
    assert fold.get(state, "z").collect() == []


def test_reserved_keys(spark):
    df = spark.createDataFrame([("a",), ("",), ("\0internal",), (None,)], "k string")
    assert [r.s for r in df.select(oplog.key_status(F.col("k")).alias("s")).collect()] == ["ok", "invalid", "invalid", "invalid"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(6000):
        kind = rng.random()
        k = f"key{rng.randrange(400):08d}"
        rows.append(("delete", k, None) if kind < 0.2 else ("append" if kind < 0.5 else "put", k, f"value-{i}" + "x" * rng.randrange(8)))
    log = log_of(spark, rows)
    assert held(fold.fold(log)) == model(rows)
    assert held(fold.as_of(log, 2500)) == model(rows[:2500])


def test_retries_apply_once(spark):
    rows = [(2 * i + 1, 1, 0, 7, i + 1, "append", "k", "x") for i in range(100)]
    rows += [(2 * i + 2, 1, 0, 7, i + 1, "append", "k", "x") for i in range(100)]
    log = spark.createDataFrame(rows, OP_LOG)
    assert held(fold.fold(oplog.accepted(log))) == {"k": "x" * 100}
    assert oplog.rejected(log).count() == 100


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_exactly_once_equals_a_sequential_filter(spark, stretch):
    rng = random.Random(stretch)
    rows = [(i, 1, rng.randrange(2), rng.randrange(3), rng.randrange(0, 40), rng.choice(["put", "append", "delete", "get"]), f"k{rng.randrange(5)}", str(i)) for i in range(1, 400)]
    last: dict[tuple[int, int], int] = {}
    want = set()
    for idx, _, part, client, seq, op, _, _ in rows:
        if op != "get" and seq > last.get((part, client), 0):
            last[part, client] = seq
            want.add(idx)
    log = spark.createDataFrame(rows, OP_LOG)
    assert {r.idx for r in oplog.accepted(log, stretch).collect()} == want
    assert {r.idx for r in oplog.rejected(log, stretch).collect()} == {r[0] for r in rows if r[5] != "get"} - want


def test_equality_is_not_enough_for_exactly_once(spark):
    """An older number behind a newer one is dropped though it was never seen."""
    log = spark.createDataFrame([(1, 1, 0, 1, 5, "put", "a", "1"), (2, 1, 0, 1, 4, "put", "b", "2"), (3, 1, 0, 1, 0, "put", "c", "3")], OP_LOG)
    assert [r.idx for r in oplog.accepted(log).collect()] == [1]


def test_empty_log(spark):
    log = spark.createDataFrame([], OP_LOG)
    assert fold.fold(oplog.accepted(log)).collect() == []


def test_restart_values(spark):
    rows = [("put", f"k{i % 500}", chr(ord("a") + i % 26) * 64) for i in range(1500)] + [("delete", f"k{i}", None) for i in range(0, 500, 5)]
    got = held(fold.fold(log_of(spark, rows)))
    assert got == {f"k{i}": chr(ord("a") + (1000 + i) % 26) * 64 for i in range(500) if i % 5}


@pytest.mark.parametrize("stretch", [1, 5, 1 << 20])
def test_last_before(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), i, rng.choice([None, i])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long")
    got = {r.id: r.p for r in last_before(df, ["k"], "at", F.col("v"), "p", ("id",), stretch).collect()}
    want, last = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = last.get(k)
        if v is not None:
            last[k] = v
    assert got == want


@pytest.mark.parametrize("stretch", [2, 1 << 20])
def test_read_versions(spark, stretch):
    log = log_of(spark, [("put", "a", "1"), ("put", "b", "1"), ("append", "a", "2"), ("delete", "a", None)])
    reads = spark.createDataFrame([(1, "a", 0), (2, "a", 2), (3, "a", 3), (4, "a", 9), (5, "c", 9)], "read_id long, k string, read_idx long")
    got = {r.read_id: (r.version, r.op) for r in fold.read_versions(log, reads, stretch).collect()}
    assert got == {1: (None, None), 2: (1, "put"), 3: (3, "append"), 4: (4, "delete"), 5: (None, None)}


# --- runs --------------------------------------------------------------------------------------------


def entries(spark, rows):
    return spark.createDataFrame(rows, RUN_ENTRY)


RUNS = [
    (0, 2, "a", False, "new"), (0, 1, "a", False, "old"), (0, 1, "b", True, None), (1, 0, "b", False, "1"), (1, 0, "c", True, None),
    (1, 1, "x", True, None), (2, 0, "c", False, "2"), (2, 0, "d", False, "3"), (2, 5, "y", False, "4"),
]


def test_merge_takes_the_newest(spark):
    got = {r.k: (r.is_tombstone, r.v, r.level) for r in runs.merge(entries(spark, RUNS)).collect()}
    assert got == {"a": (False, "new", 0), "b": (True, None, 0), "c": (True, None, 1), "x": (True, None, 1), "d": (False, "3", 2), "y": (False, "4", 2)}
    assert held(runs.live(entries(spark, RUNS))) == {"a": "new", "d": "3", "y": "4"}


def test_compaction_keeps_what_shadows(spark):
    e = entries(spark, RUNS)
    out = runs.compact(e, runs.manifest(e), [(0, 1), (0, 2), (1, 0), (1, 1)], 1, 9)
    # b and x shadow nothing below level 1; c's key lies in a range of level 2
    assert {(r.k, r.is_tombstone) for r in out.collect()} == {("a", False), ("c", True)}
    after = out.unionByName(e.where("level = 2"))
    assert held(runs.live(after)) == held(runs.live(e))


def test_picking(spark):
    files = spark.createDataFrame([(0, 1, 5, "a", "c"), (1, 1, 30, "a", "f"), (1, 2, 30, "g", "k"), (2, 1, 10, "h", "i")], "level int, run_id long, size long, smallest string, largest string")
    scores = {r.level: r.score for r in runs.level_scores(files, l1_bytes=60, growth=1, trigger=1).collect()}
    assert scores == {0: 1.0, 1: 1.0, 2: 10 / 60, 3: 0, 4: 0, 5: 0, 6: 0}
    assert runs.pick_level(runs.level_scores(files, l1_bytes=60, growth=1, trigger=1)).first().level == 1  # of equal scores the deeper
    assert runs.pick_level(runs.level_scores(files)).collect() == []
    pick = lambda at: [r.run_id for r in runs.pick_file(files, 1, at).collect()]
    assert pick(None) == [1] and pick("f") == [2] and pick("z") == [1]
    assert [r.run_id for r in runs.trivial_moves(files, 1).collect()] == [1]
    assert {(r.level, r.run_id) for r in runs.moved(files, runs.trivial_moves(files, 1)).collect()} == {(0, 1), (2, 1), (1, 2)}
    assert {(r.run_id, r.below_id) for r in runs.overlaps(files, 1).collect()} == {(2, 1)}
    assert sorted((r.level, r.run_id) for r in runs.lookup_candidates(spark.createDataFrame([("h",)], "k string"), files).collect()) == [(1, 2), (2, 1)]


def test_stretches_are_disjoint(spark):
    files = spark.createDataFrame([(1, 1, 1, "a", "c"), (1, 2, 1, "b", "e"), (1, 3, 1, "f", "g"), (1, 4, 1, "g", "h")], "level int, run_id long, size long, smallest string, largest string")
    assert sorted((r.smallest, r.largest) for r in runs.stretches(files).collect()) == [("a", "e"), ("f", "h")]


def test_run_files(spark, tmp_path):
    rows = [(0, 0, f"key{i:08d}", i % 10 == 0, None if i % 10 == 0 else f"v{i}") for i in range(0, 5000, 2)]
    random.Random(0).shuffle(rows)
    runs.write_run(entries(spark, rows), str(tmp_path / "run"))
    back = spark.read.parquet(str(tmp_path / "run"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows, key=lambda r: r[2])
    assert back.where("k = 'key00000010'").count() == 1 and back.where("k = 'key00000011'").count() == 0
    plan = back.where("k = 'key00000010'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,key00000010)]" in plan


def test_split_files_are_even(spark):
    rows = [(0, 0, f"key{i:08d}", False, "v") for i in range(1000)]
    got = runs.split_files(entries(spark, rows), 4, prefix=9).groupBy("file").agg(F.count("k").alias("n"), F.min("k").alias("k")).orderBy("file").collect()
    assert [(r.file, r.n, r.k) for r in got] == [(i, 250, f"key{250 * i:08d}") for i in range(4)]


def test_damaged_run_raises(spark, tmp_path):
    path = tmp_path / "run"
    entries(spark, [(0, 0, f"key{i:08d}", False, "v" * 50) for i in range(100)]).coalesce(1).write.parquet(str(path))
    file = next(p for p in path.iterdir() if p.name.startswith("part"))
    data = bytearray(file.read_bytes())
    data[-20] ^= 0xFF
    file.write_bytes(bytes(data))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(str(path)).collect()


def test_recovery_equals_model(spark):
    rng = random.Random(4)
    rows = [("put", f"k{rng.randrange(100)}", str(i)) if rng.random() < 0.8 else ("delete", f"k{rng.randrange(100)}", None) for i in range(1200)]
    parts = [rows[:400], rows[400:800]]
    flushed = []
    for n, part in enumerate(parts):
        log = log_of(spark, part).select("k", (F.col("op") == "delete").alias("is_tombstone"), "v", "idx")
        flushed.append(runs.flush(log, [F.col("idx")], 0, n))
    tail = log_of(spark, rows[800:])
    assert held(runs.recover(flushed[0].unionByName(flushed[1]), tail)) == model(rows)


def test_recovery_folds_appends(spark):
    """Appends in the tail add to what the runs hold, start a key that they do not hold, and follow a put or delete of the tail."""
    runs_ = runs.flush(log_of(spark, [("put", "a", "1"), ("put", "b", "1"), ("put", "c", "1"), ("delete", "d", None)]).select("k", (F.col("op") == "delete").alias("is_tombstone"), "v", "idx"), [F.col("idx")], 0, 0)
    tail = [("append", "a", "2"), ("append", "a", "3"), ("put", "b", "x"), ("append", "b", "y"), ("delete", "c", None), ("append", "c", "z"), ("append", "d", "q"), ("append", "e", "n"), ("append", "f", "o"), ("delete", "f", None)]
    assert held(runs.recover(runs_, log_of(spark, tail))) == {"a": "123", "b": "xy", "c": "z", "d": "q", "e": "n"}


def test_exactly_once_keeps_rows_with_nulls(spark):
    """Every mutation is accepted or rejected, also those without client, partition, index or sequence number."""
    rows = [(1, 1, 0, 1, 1, "put", "a", "v"), (2, 1, 0, None, 1, "put", "a", "v"), (3, 1, None, 1, 1, "put", "a", "v"), (None, 1, 0, 1, 5, "put", "a", "v"), (4, 1, 0, None, 1, "put", "a", "v"), (5, 1, 0, 1, None, "put", "a", "v")]
    log = spark.createDataFrame(rows, OP_LOG)
    yes, no = oplog.accepted(log).collect(), oplog.rejected(log).collect()
    assert len(yes) + len(no) == len(rows)
    assert (2, None) in {(r.idx, r.client_id) for r in yes} and (4, None) in {(r.idx, r.client_id) for r in no}


@pytest.mark.parametrize("stretch", [1, 4, 1 << 20])
def test_numbers_in_stretches_are_row_numbers(spark, stretch):
    rng = random.Random(stretch)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), i) for i in range(200)]
    got = {r.i: r.nth for r in numbered(spark.createDataFrame(data, "k string, at long, i long"), ["k"], "at", "nth", ("i",), stretch).collect()}
    for key in ("a", "b", None):
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
