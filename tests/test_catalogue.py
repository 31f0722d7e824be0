"""Every named query against its SQL, or its own invariants, on the driver's tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from tidelog.operators import history
from tidelog.plans import catalogue
from tidelog.plans.catalogue import QUERIES, SQL

DATA = os.environ.get("TIDELOG_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    assert_same(QUERIES[name](spark, DATA), db, SQL[name])


def test_all_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def one(spark, name):
    (row,) = QUERIES[name](spark, DATA).collect()
    return row.asDict()


def test_bloom_filter_loses_nothing(spark):
    r = one(spark, "bloom_exact_filter")
    assert r["false_negatives"] == 0 and r["asked"] == r["passed"] + (r["asked"] - r["passed"]) and r["false_positives"] <= 0.03 * r["asked"]


def test_generated_history_is_linearizable(spark):
    assert one(spark, "linearizable_history") == {"ok": True, "bad_key": None, "unknown_keys": 0}
    made = history.executed(history.workload(spark, 5, 200, 40, seed=7))
    assert history.summary(history.check(made)).first().asDict() == {"ok": True, "bad_key": None, "unknown_keys": 0}
    assert history.stats(made).first().asDict() == {"ops": 1000, "keys": 40, "clients": 5}


def test_a_wrong_answer_in_the_history_of_events_is_found(spark):
    made = catalogue.checked_history(spark, DATA)
    first = made.where("op = 'get'").agg(F.min(F.struct("k", "call_ns")).alias("x")).first().x
    bent = made.withColumn("output", F.when((F.col("k") == first.k) & (F.col("call_ns") == first.call_ns), "never written").otherwise(F.col("output")))
    assert history.summary(history.check(bent)).first().asDict() == {"ok": False, "bad_key": first.k, "unknown_keys": 0}


def test_rebalance_moves_about_an_eleventh(spark):
    assert 0.04 < one(spark, "ring_rebalance")["fraction"] < 0.18


def test_ring_points(spark):
    rows = QUERIES["ring_points"](spark, DATA).collect()
    assert len(rows) == 5 * 64 and {r.node_id for r in rows} == {1, 2, 3, 4, 5}


def test_crc_prefix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("source", "doc_id").collect()
    want: dict[str, int] = {}
    for source in {d.source for d in docs}:
        ids = sorted(d.doc_id for d in docs if d.source == source)
        bad = next((i for i, x in enumerate(ids) if x % 211 == 210), len(ids))
        if bad:
            want[source] = bad
    assert {r.source: r.records for r in QUERIES["crc_valid_prefix"](spark, DATA).collect()} == want


def test_cache_replay(spark):
    rows = QUERIES["cache_replay"](spark, DATA).collect()
    assert sum(r.reads for r in rows) == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert all(0 <= r.hits <= r.reads for r in rows)


def test_faults_are_deterministic(spark):
    first = QUERIES["fault_delivery_order"](spark, DATA).collect()
    again = QUERIES["fault_delivery_order"](spark, DATA).collect()
    assert sorted(first) == sorted(again) and first
    for dst in {r.dst for r in first}:
        mine = sorted((r.position, r.at_ms, r.seq) for r in first if r.dst == dst)
        assert [p for p, _, _ in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: x[1:])
    assert all(0 <= r.at_ms - r.sent_ms <= 25 for r in first)
