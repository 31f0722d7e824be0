"""Hashing, placement, filters, formats, consensus rules, histories, figures and streams."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.functions import bloom, codecs, hashing, text
from tidelog.operators import cache, consensus, history, metrics, placement
from tidelog.schemas import HISTORY, OP_LOG
from tidelog.sources import config, wal
from tidelog.sources.snapshots import Snapshots
from tidelog.streaming import apply, faults

# --- hashing and placement -----------------------------------------------------------------------------


def murmur_plain(data: bytes, seed: int) -> int:
    top = (1 << 64) - 1
    h = seed ^ (len(data) * hashing.MULTIPLIER & top)
    for i in range(0, len(data) - 7, 8):
        k = int.from_bytes(data[i : i + 8], "little") * hashing.MULTIPLIER & top
        h = (h ^ ((k ^ k >> 47) * hashing.MULTIPLIER & top)) * hashing.MULTIPLIER & top
    if len(data) % 8:
        h = (h ^ int.from_bytes(data[len(data) // 8 * 8 :], "little")) * hashing.MULTIPLIER & top
    h = (h ^ h >> 47) * hashing.MULTIPLIER & top
    return h ^ h >> 47


def test_murmur():
    rng = random.Random(1)
    keys = [bytes(rng.randrange(256) for _ in range(n % 79)) for n in range(500)]
    for seed in (hashing.DEFAULT_SEED, hashing.PARTITION_SEED):
        assert hashing.murmur64a(pa.array(keys, pa.binary()).slice(3), seed).tolist() == [murmur_plain(k, seed) for k in keys[3:]]
    known = hashing.murmur64a(pa.array(["", "a", "hello"]))
    assert known.tolist() == [9482155760047181906, 16819645283534271406, 4228968072151562277]
    assert hashing.murmur64a(pa.array(["hello"]), hashing.PARTITION_SEED).tolist() == [2638971011346341618]


def test_hash_columns(spark):
    df = spark.createDataFrame([("a",), ("hello",), (None,)], "k string")
    rows = df.select(hashing.unsigned(hashing.hash64(F.col("k"))).alias("h"), hashing.partition_for(F.col("k"), 7).alias("p")).collect()
    assert [r.h for r in rows] == [16819645283534271406, 4228968072151562277, None]
    assert [r.p for r in rows] == [murmur_plain(b"a", 0x5EED) % 7, 2638971011346341618 % 7, None]


def test_known_placements():
    assert placement.replicas([1, 2, 3], 6) == {0: [2, 3, 1], 1: [3, 1, 2], 2: [2, 1, 3], 3: [3, 1, 2], 4: [2, 3, 1], 5: [2, 1, 3]}
    five = placement.replicas([1, 2, 3, 4, 5], 12)
    assert [five[p] for p in range(12)] == [[2, 3, 4], [3, 1, 5], [2, 1, 5], [3, 4, 5], [2, 3, 5], [5, 2, 1], [2, 4, 1], [5, 4, 2], [1, 3, 4], [2, 4, 5], [3, 5, 4], [4, 3, 5]]


def test_ring():
    r = placement.ring([1, 2, 3, 4, 5])
    for i in range(200):
        found = r.lookup(f"key{i}", 3)
        assert len(set(found)) == 3
    assert sorted(r.lookup("x", 99)) == [1, 2, 3, 4, 5] and r.lookup("x", 0) == []
    before = dict(r.owner)
    r.add(3)
    assert r.owner == before
    r.remove(3)
    r.remove(3)
    assert 3 not in r.lookup("x", 9)
    r.add(3)
    assert r.owner == before and placement.Ring().lookup("x", 2) == []


def test_load_is_even_and_few_keys_move(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("k"))
    ten, eleven = placement.ring(list(range(1, 11)), 128), placement.ring(list(range(1, 12)), 128)
    load = placement.owners(keys, ten).groupBy("node_id").agg(F.count("k").alias("keys"))
    assert placement.spread(load).first().ratio < 2
    m = placement.moved(placement.owners(keys, ten), placement.owners(keys, eleven)).first()
    assert m["keys"] == 20_000 and abs(m["fraction"] - 1 / 11) < 0.05
    assert placement.owners(keys.limit(1), placement.Ring()).first().node_id is None


def test_bloom():
    present = pa.array([f"key{i:08d}" for i in range(10_000)])
    absent = pa.array([f"key{i:08d}" for i in range(10_000, 20_000)])
    k = bloom.probes(10)
    made = bloom.fill(present, bloom.size_bytes(10_000), k)
    assert k == 6 and bloom.may_contain(made, present, k).all() and bloom.may_contain(made, absent, k).sum() < 200
    assert bloom.may_contain(b"", absent, k).all() and bloom.size_bytes(0) == 8
    assert [bloom.probes(b) for b in (0, 1, 2, 100)] == [1, 1, 1, 30]


def test_distributed_bloom_equals_one_pass(spark):
    keys = spark.range(0, 3000, 1, 7).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    made = bloom.build(keys, "k", 3000)
    assert made == bloom.fill(pa.array([f"k{i}" for i in range(3000)]), bloom.size_bytes(3000), bloom.probes(10))
    assert keys.where(bloom.contains(made, F.col("k"))).count() == 3000


# --- formats -----------------------------------------------------------------------------------------------


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**32, 2**64 - 1):
        c = codecs.Cursor(codecs.varint(n) + b"z")
        assert c.varint() == n and c.take(1) == b"z" and c.done()
    for bad in (b"", b"\x80", b"\xff" * 11):
        c = codecs.Cursor(bad)
        c.varint()
        assert c.failed
    with pytest.raises(ValueError):
        codecs.varint(-1)
    assert codecs.Cursor(codecs.fixed32(7) + codecs.fixed64(9)).fixed32() == 7


def test_batches():
    ops = [(1, b"a", b"1"), (0, b"b", b""), (1, b"", b"")]
    data = codecs.encode_batch(ops)
    assert codecs.decode_batch(data) == ops and codecs.decode_batch(codecs.encode_batch([])) == []
    assert codecs.decode_batch(data + b"x") is None and codecs.decode_batch(data[:-1]) is None and codecs.decode_batch(b"\x01\x07\x00") is None


def test_torn_log(spark, tmp_path):
    whole = b"".join(wal.frame(f"record-{i}".encode()) for i in range(100))
    (tmp_path / "a.log").write_bytes(whole[:-3])
    damaged = bytearray(whole)
    damaged[9] ^= 1
    (tmp_path / "b.log").write_bytes(bytes(damaged))
    got = wal.read(spark, str(tmp_path)).collect()
    assert [bytes(r.payload).decode() for r in sorted(got, key=lambda r: r.pos)] == [f"record-{i}" for i in range(99)]
    assert wal.good_offset(whole[:-3]) == len(whole) - len(wal.frame(b"record-99")) and wal.good_offset(b"") == 0
    spark.dataSource.register(wal.WalSource)
    assert spark.read.format("tidewal").load(str(tmp_path / "a.log")).count() == 99


def test_torn_batch_shows_nothing(spark, tmp_path):
    first = wal.frame(codecs.encode_batch([(1, b"before", b"ok"), (0, b"gone", b"")]))
    second = wal.frame(codecs.encode_batch([(1, f"k{i}".encode(), b"v") for i in range(50)]))
    (tmp_path / "c.log").write_bytes(first + second[:-5])
    rows = wal.operations(wal.read(spark, str(tmp_path))).orderBy("nth").collect()
    assert [(r.op, bytes(r.k), r.v and bytes(r.v)) for r in rows] == [("put", b"before", b"ok"), ("delete", b"gone", None)]


def test_intact_prefix_of_a_table(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "x")], "log string, pos int, p string")
    df = df.withColumn("crc", F.crc32(F.col("p").cast("binary")) + F.when((F.col("log") == "a") & (F.col("pos") == 2), 1).otherwise(0))
    assert sorted((r.log, r.pos) for r in wal.intact_prefix(df, ["log"], "pos", "crc", "p").collect()) == [("a", 1), ("b", 1)]


def test_config():
    c = config.parse("partitions 16\nreplication 3 # copies\n\nvnodes 64\n" + "".join(f"node {i} 127.0.0.1:{7000 + i} extra\n" for i in range(1, 6)) + "node 5 10.0.0.1:1\n# end")
    assert (c.partitions, c.replication, c.vnodes, c.node_ids()) == (16, 3, 64, [1, 2, 3, 4, 5]) and c.nodes[5] == "10.0.0.1:1"
    assert config.parse("node 1 a:1").partitions == 8
    for bad, line in (("partitions x", 1), ("node 1 a:1\nwhat 3", 2), ("node 1", 1), ("partitions 0\nnode 1 a:1", 1)):
        with pytest.raises(config.ConfigError, match=f"line {line}"):
            config.parse(bad)
    with pytest.raises(config.ConfigError):
        config.parse("# nothing")
    placed = placement.replicas(c.node_ids(), c.partitions, c.replication, c.vnodes)
    assert sum(len(v) for v in placed.values()) == 48


def test_text_forms(spark):
    df = spark.createDataFrame([("000123.sst",), ("1234567.log",), ("x.sst",), ("host:80",), ("a:b:65535",), ("h:65536",), ("h:",), (None,)], "s string")
    rows = df.select(text.file_number(F.col("s")).alias("n"), text.host(F.col("s")).alias("h"), text.port(F.col("s")).alias("p")).collect()
    assert [r.n for r in rows] == [123, 1234567, None, None, None, None, None, None]
    assert [(r.h, r.p) for r in rows[3:]] == [("host", 80), ("a:b", 65535), (None, None), (None, None), (None, None)]
    keys = spark.createDataFrame([(b"\x00\xffA",), (b"",)], "k binary").select(text.key_hex(F.col("k")).alias("t"))
    assert [(r.t, bytes(r.b)) for r in keys.select("t", text.key_from_hex(F.col("t")).alias("b")).collect()] == [("k00ff41", b"\x00\xffA"), ("k", b"")]
    assert spark.range(1).select(text.file_name(F.lit(7), "sst").alias("a"), text.file_name(F.lit(12345678), "log").alias("b")).first() == ("000007.sst", "12345678.log")


# --- consensus ------------------------------------------------------------------------------------------------


def test_wrong_acknowledgements(spark):
    pending = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (0, 9, 2)], "part int, idx long, term long")
    applied = spark.createDataFrame([(0, 5, 2), (0, 6, 2)], "part int, idx long, term long")
    assert {r.idx: r.status for r in consensus.acknowledge(pending, applied).collect()} == {5: "wrong_leader", 6: "ok", 9: "pending"}


def test_divergent_logs_meet(spark):
    schema = "part int, node_id long, idx long, term long, etype string, data string"
    same = [(0, 0, i, 1, "command", f"c{i}") for i in range(1, 11)]
    good = spark.createDataFrame(same + [(0, 0, i, 3, "command", f"good{i}") for i in range(11, 61)], schema)
    doomed = spark.createDataFrame([(0, 1, *r[2:]) for r in same] + [(0, 1, i, 2, "command", f"doomed{i}") for i in range(11, 61)], schema)
    assert consensus.first_conflict(good, doomed).first().conflict_idx == 11
    after = consensus.append_entries(good, doomed).collect()
    assert sorted(r.idx for r in after) == list(range(1, 61)) and not [r for r in after if r.data.startswith("doomed")]
    both = good.unionByName(doomed)
    assert consensus.disagreements(both).count() == 50 and consensus.gaps(both).count() == 0
    terms = {(r.node_id, r.term): (r.first_idx, r.last_idx) for r in consensus.conflict_terms(both).collect()}
    assert terms[1, 2] == (11, 60)


def test_commit_needs_a_majority(spark):
    rows = [(0, 1, 7), (0, 2, 5), (0, 3, 9), (1, 1, 4), (1, 2, 3)]
    got = consensus.commit_index(spark.createDataFrame(rows, "part int, node_id long, match_idx long"), 5)
    assert {r.part: r.commit_index for r in got.collect()} == {0: 5, 1: 0}


def test_votes(spark):
    cols = "voter long, term long, candidate long, at long, last_term long, last_idx long, own_term long, own_idx long"
    rows = [(1, 1, 8, 1, 1, 1, 1, 5), (1, 1, 9, 2, 1, 5, 1, 5), (1, 1, 7, 3, 2, 0, 1, 5), (1, 1, 9, 4, 1, 5, 1, 5)]
    got = {r["at"]: r.granted for r in consensus.grants(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_sessions(spark):
    beats = spark.createDataFrame([(1, 0), (1, 100), (1, 500), (2, 0)], "node_id long, at_ms long")
    assert [(r.previous_ms, r.at_ms) for r in consensus.silences(beats).collect()] == [(100, 500)]
    assert sorted((r.node_id, r.session, r.beats) for r in consensus.sessions(beats).collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 1)]


# --- histories ----------------------------------------------------------------------------------------------------


def op(kind, value, out, call, ret):
    return kind, value, out, call, ret


def test_known_histories():
    sequential = [op("put", "a", "", 0, 1), op("get", "", "a", 2, 3), op("append", "b", "", 4, 5), op("get", "", "ab", 6, 7), op("delete", "", "", 8, 9), op("get", "", "", 10, 11)]
    assert history.check_key(sequential) == "ok"
    for seen in ("", "1"):
        assert history.check_key([op("put", "1", "", 0, 10), op("get", "", seen, 3, 5)]) == "ok"
    assert history.check_key([op("put", "1", "", 0, 1), op("put", "2", "", 2, 3), op("get", "", "1", 4, 5)]) == "violation"
    assert history.check_key([op("append", "a", "", 0, 1), op("append", "b", "", 2, 3), op("get", "", "b", 4, 5)]) == "violation"
    back = [op("put", "1", "", 0, 1), op("put", "2", "", 2, 20), op("get", "", "2", 4, 5), op("get", "", "1", 6, 7)]
    assert history.check_key(back) == "violation"
    assert history.check_key([]) == "ok" and history.check_key(back, steps=0) == "unknown"
    with pytest.raises(ValueError):
        history.check_key([op("cas", "", "", 0, 1)])


@pytest.mark.parametrize("seed", range(30))
def test_checker_equals_brute_force(seed):
    rng = random.Random(seed)
    ops = []
    for _ in range(5):
        call = rng.randrange(12)
        kind = rng.choice(["get", "get", "put", "append", "delete"])
        ops.append(op(kind, rng.choice("xy") if kind in ("put", "append") else "", rng.choice(["", "x", "y", "xy"]) if kind == "get" else "", call, call + rng.randrange(1, 8)))

    def legal(order):
        state = ""
        for i in order:
            ok, state = history.apply(state, ops[i][0], ops[i][1], ops[i][2])
            if not ok:
                return False
        return all(not ops[b][4] < ops[a][3] for a, b in itertools.combinations(order, 2))

    want = any(legal(p) for p in itertools.permutations(range(5)))
    assert history.check_key(ops) == ("ok" if want else "violation")


def test_check_names_the_first_bad_key(spark):
    rows = [(1, "put", k, "1", "", 0, 1) for k in "abc"] + [(1, "get", k, "", "9" if k in "bc" else "1", 2, 3) for k in "abc"]
    got = history.summary(history.check(spark.createDataFrame(rows, HISTORY))).first()
    assert (got.ok, got.bad_key) == (False, "b")
    assert history.summary(history.check(spark.createDataFrame([], HISTORY))).first().ok


def test_workload_mix(spark):
    w = history.workload(spark, 5, 2000, 4).groupBy("op").count().collect()
    share = {r["op"]: r["count"] / 10_000 for r in w}
    assert all(abs(share[k] - v) < 0.03 for k, v in {"get": 0.4, "put": 0.2, "append": 0.35, "delete": 0.05}.items())


# --- figures, caches, streams -----------------------------------------------------------------------------------------


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(x)) for g in ("a", "b") for x in rng.integers(0, 40, 101)] + [("c", 5), ("d", None)]
    got = {r.g: (r.n, r.p50, r.p99) for r in metrics.order_statistics(spark.createDataFrame(rows, "g string, x int"), ["g"], "x", {"p50": 0.5, "p99": 0.99}).collect()}
    for g in ("a", "b"):
        x = sorted(v for h, v in rows if h == g)
        assert got[g] == (101, x[50], x[99])
    assert got["c"] == (1, 5, 5) and "d" not in got


def test_ratios(spark):
    r = spark.range(1).select(metrics.ratio(F.lit(1), F.lit(4)).alias("a"), metrics.ratio(F.lit(1), F.lit(0)).alias("b"), *(c.alias(n) for n, c in metrics.throughput(F.lit(10), F.lit(1048576), F.lit(0.0)).items())).first()
    assert (r.a, r.b, r.ops_per_s, r.us_per_op) == (0.25, 0.0, None, 0.0)


def test_lru(spark):
    c = cache.LruCache(3)
    assert [c.access(k, 1) for k in "abcadb"] == [False, False, False, True, False, False]
    rows = [(0, i, k, 1) for i, k in enumerate("abcadb")]
    got = cache.replay(spark.createDataFrame(rows, "shard long, seq long, key string, charge long"), 3).orderBy("seq").collect()
    assert [r.hit for r in got] == [False, False, False, True, False, False]
    assert [r.key for r in cache.recency(spark.createDataFrame(rows, "shard long, seq long, key string, charge long")).orderBy("rank").collect()] == ["b", "d", "a", "c"]


def test_faults(spark):
    m = spark.range(5000).select(F.col("id").alias("seq"), (F.col("id") % 5).alias("src"), (F.col("id") % 3).alias("dst"), F.col("id").alias("sent_ms"))
    got = {r.status: r.messages for r in faults.counts(faults.deliver(m)).collect()}
    assert abs(got["lost"] / 5000 - 0.1) < 0.02 and got["lost"] + got["delivered"] == 5000
    assert {r.status for r in faults.counts(faults.deliver(m, drop_percent=0, groups=[[0], [1], [2]])).collect()} == {"cut", "delivered"}


def stream_rows(seed):
    rng = random.Random(seed)
    rows, seq = [], {}
    for i in range(1, 301):
        client = rng.randrange(4)
        if rng.random() < 0.8:
            seq[client] = seq.get(client, 0) + 1
        kind = rng.choice(["put", "append", "append", "delete", "get"])
        rows.append((i, 1, client % 2, client, max(1, seq.get(client, 1)), kind, f"k{rng.randrange(6)}", f"{i};" if kind in ("put", "append") else None))
    return rows


def sequential(rows):
    last, state = {}, {}
    done = []
    for idx, _, part, client, seq, kind, k, v in rows:
        if kind != "get" and seq > last.get((part, client), 0):
            last[part, client] = seq
            done.append(idx)
            if kind == "put":
                state[k] = v
            elif kind == "append":
                state[k] = state.get(k, "") + v
            else:
                state.pop(k, None)
    return state, done


@pytest.mark.parametrize("size", [300, 40])
def test_batches_and_restart(spark, tmp_path, size):
    rows = stream_rows(size)
    store = Snapshots(str(tmp_path / "store"))
    batches = [spark.createDataFrame(rows[i : i + size], OP_LOG) for i in range(0, 300, size)]
    half = max(1, len(batches) // 2)
    apply.replay(spark, batches[:half], store)
    assert store.committed(spark) == half - 1
    apply.replay(spark, batches, Snapshots(str(tmp_path / "store")))
    state, _ = store.load(spark)
    assert {r.k: r.v for r in state.collect()} == sequential(rows)[0]


def test_two_writers_cannot_commit_one_batch(spark, tmp_path):
    store = Snapshots(str(tmp_path))
    state, seqs = store.load(spark)
    store.commit(spark, 0, state, seqs)
    with pytest.raises(RuntimeError):
        store.commit(spark, 0, state, seqs)


def test_stream_into_snapshots(spark, tmp_path):
    rows = stream_rows(9)
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], OP_LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    entries = spark.readStream.schema(OP_LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    store = Snapshots(str(tmp_path / "store"))
    apply.apply_batches(entries, store, str(tmp_path / "checkpoint")).awaitTermination()
    apply.apply_batches(entries, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.k: r.v for r in store.load(spark)[0].collect()} == sequential(rows)[0]


def test_stateful_acceptance(spark, tmp_path):
    rows = stream_rows(5)
    spark.createDataFrame(rows, OP_LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    entries = spark.readStream.schema(OP_LOG).parquet(str(tmp_path / "in"))
    q = apply.accept_stream(entries).writeStream.format("memory").queryName("accepted_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.idx for r in spark.table("accepted_rows").collect()) == sequential(rows)[1]


def test_windowed_latency(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, id AS v FROM range(0, 7200, 60)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, v long").parquet(str(tmp_path / "in"))
    q = apply.windowed_latency(stream, "ts", "v", "30 minutes", "1 minute").writeStream.format("memory").queryName("lat").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.most) for r in spark.table("lat").collect()) == [(30, 1740), (30, 3540), (30, 5340), (30, 7140)]


def test_history_that_is_not_searched_to_the_end_is_not_ok(spark):
    rows = [(1, "append", "a", f"{i}", "", 0, 9) for i in range(6)] + [(1, "get", "a", "", "x", 0, 9)]
    frame = spark.createDataFrame(rows, HISTORY)
    cut = history.summary(history.check(frame, steps=3)).first()
    assert cut.ok is None and cut.unknown_keys == 1
    whole = history.summary(history.check(frame)).first()
    assert whole.ok is False and whole.bad_key == "a" and whole.unknown_keys == 0
