"""Run stores and the command line."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_log import held, log_of, model
from tidelog import cli
from tidelog.operators import runs
from tidelog.sources.files import Manifests
from tidelog.sources.run_store import RunStore, decode_key, encode_key


def test_manifest_keys():
    for k in ("", "a", "é\0x"):
        assert decode_key(encode_key(k)) == k
    with pytest.raises(ValueError):
        decode_key("61")


def test_manifest_numbers_are_taken_once(spark, tmp_path):
    m = Manifests(str(tmp_path / "m"))
    assert m.newest(spark) is None
    m.commit(spark, 0, {"a": 1})
    m.commit(spark, 1, {"a": 2})
    assert m.newest(spark) == (1, {"a": 2})
    with pytest.raises(RuntimeError):
        m.commit(spark, 1, {"a": 3})
    assert m.newest(spark) == (1, {"a": 2})


def test_flushes_and_compactions_keep_the_state(spark, tmp_path):
    rng = random.Random(6)
    rows, store = [], RunStore(str(tmp_path / "s"), trigger=2, l1_bytes=300, growth=2)
    done = []
    for n in range(5):
        lo = 100 * (n % 3)
        part = [("delete", f"k{lo + rng.randrange(60):04d}", None) if rng.random() < 0.3 else ("put", f"k{lo + rng.randrange(60):04d}", f"{n}.{i}") for i in range(50)]
        rows += part
        store.flush(spark, log_of(spark, part))
        while (step := store.compact(spark)) is not None:
            done.append(step)
            assert len(done) < 40
        assert held(store.state(spark)) == model(rows)
    assert {how for _, how in done} == {"move", "merge"} and {level for level, _ in done} >= {0, 1}
    keys = spark.createDataFrame([("k0003",), ("k0150",), ("zz",)], "k string")
    assert held(store.get(spark, keys)) == {k: v for k, v in model(rows).items() if k in ("k0003", "k0150")}
    assert held(store.get(spark, keys.where("false"))) == {}
    tail = [("delete", "k0003", None), ("put", "new", "1")]
    assert held(store.state(spark, log_of(spark, tail))) == model(rows + tail)
    stats = {r.level: r.files for r in runs.level_stats(store.files(spark)).collect()}
    assert sum(stats.values()) == store.files(spark).count() and stats[0] < 2
    dead = store.entries(spark).where("is_tombstone")
    deepest = store.files(spark).agg(F.max("level")).first()[0]
    assert dead.where(F.col("level") == deepest).count() == 0


def test_flush_appends_to_what_the_store_holds(spark, tmp_path):
    rows, store = [], RunStore(str(tmp_path / "a"), trigger=2)
    for part in ([("put", "a", "1"), ("append", "b", "1")], [("append", "a", "2"), ("delete", "b", None)], [("append", "a", "3"), ("append", "b", "4"), ("put", "c", "5"), ("append", "c", "6")]):
        rows += part
        store.flush(spark, log_of(spark, part))
        assert held(store.state(spark)) == model(rows)
    store.compact(spark)
    assert held(store.state(spark)) == model(rows) == {"a": "123", "b": "4", "c": "56"}
    many = spark.range(30).select(F.when(F.col("id") < 3, F.substring(F.lit("abc"), F.col("id").cast("int") + 1, F.lit(1))).otherwise(F.col("id").cast("string")).alias("k"))
    assert held(store.get(spark, many)) == model(rows)


def test_commands(spark, tmp_path):
    at = str(tmp_path / "kv")
    say = lambda *words: cli.run(spark, at, list(words))
    assert say("get", "a") == "(not found)" and say("put", "a", "x", "y") == "ok" and say("append", "a", "!") == "ok"
    assert say("get", "a") == "x y!" and say("del", "a") == "ok" and say("get", "a") == "(not found)"
    assert say("put", "", "v") == "invalid key" and say("put", "\0in", "v") == "invalid key" and say("what", "a").startswith("usage") and say("put", "a").startswith("usage")
