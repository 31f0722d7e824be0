"""The named queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import bloom, codecs, hashing, text
from tidelog.operators import cache, consensus, fold, history, metrics, oplog, placement, runs
from tidelog.plans import views
from tidelog.plans.views import table
from tidelog.sources import wal
from tidelog.streaming import faults

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

POINT_KEY, AT = "u7", 9_001
REACH_MS, ELECTION_MS = 600_000, 900_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def accepted(spark: SparkSession, d: str) -> DataFrame:
    return oplog.accepted(views.op_log(spark, d))


def state(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold(accepted(spark, d))


# --- logs and state --------------------------------------------------------------------------------


@query("oplog_normalize", f"WITH {views.LOG_SQL} SELECT idx, term, part, client_id, seq, op, k, CASE WHEN k = '' OR starts_with(k, chr(0)) THEN 'invalid' ELSE 'ok' END AS key_status FROM log")
def _(spark: SparkSession, d: str) -> DataFrame:
    return views.op_log(spark, d).select("idx", "term", "part", "client_id", "seq", "op", "k", oplog.key_status(F.col("k")).alias("key_status"))


@query("exactly_once_accept", f"WITH {views.RANKED_SQL} SELECT idx, part, client_id, seq, last_seq FROM accepted")
def _(spark: SparkSession, d: str) -> DataFrame:
    return accepted(spark, d).select("idx", "part", "client_id", "seq", "last_seq")


@query("exactly_once_rejected", f"WITH {views.RANKED_SQL} SELECT idx, part, client_id, seq, last_seq FROM ranked WHERE seq <= last_seq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return oplog.rejected(views.op_log(spark, d)).select("idx", "part", "client_id", "seq", "last_seq")


@query("last_seq_per_client", f"WITH {views.LOG_SQL} SELECT part, client_id, max(seq) AS last_seq FROM log WHERE op <> 'get' GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return oplog.last_seq(views.op_log(spark, d))


@query("applied_index", f"WITH {views.LOG_SQL} SELECT part, max(idx) AS applied, count(*) FILTER (WHERE op <> 'get') AS mutations FROM log WHERE idx > {AT} GROUP BY part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return oplog.applied_index(oplog.not_applied(views.op_log(spark, d), AT))


@query("fold_state", f"WITH {views.RANKED_SQL}, {views.fold_sql('accepted')} SELECT k, v, version FROM state")
def _(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d)


@query("point_get", f"WITH {views.RANKED_SQL}, {views.fold_sql('accepted')} SELECT k, v, version FROM state WHERE k = '{POINT_KEY}'")
def _(spark: SparkSession, d: str) -> DataFrame:
    log = views.op_log(spark, d)
    return fold.get(fold.fold(oplog.accepted(log)), POINT_KEY)


@query(
    "multi_get",
    f"WITH {views.RANKED_SQL}, {views.fold_sql('accepted')} SELECT q.k, s.v, CASE WHEN s.k IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM (SELECT 'u' || (c_custkey - 1) AS k FROM customer) q LEFT JOIN state s ON s.k = q.k",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") - 1).cast("string")).alias("k"))
    return fold.multi_get(keys, state(spark, d))


@query("state_as_of_index", f"WITH {views.RANKED_SQL}, cut AS (SELECT * FROM accepted WHERE idx <= {AT}), {views.fold_sql('cut')} SELECT k, v, version FROM state")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fold.as_of(accepted(spark, d), AT)


@query(
    "read_at_index",
    f"""WITH {views.RANKED_SQL}, reads AS (SELECT idx AS read_id, k, idx AS read_idx FROM log WHERE op = 'get')
SELECT r.read_id, r.k, r.read_idx, a.idx AS version, a.op FROM reads r ASOF LEFT JOIN accepted a ON r.k = a.k AND r.read_idx >= a.idx""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    log = views.op_log(spark, d)
    reads = log.where("op = 'get'").select(F.col("idx").alias("read_id"), "k", F.col("idx").alias("read_idx"))
    return fold.read_versions(oplog.accepted(log), reads)


@query(
    "response_status",
    f"""WITH {views.RANKED_SQL}, {views.fold_sql('accepted')} SELECT l.idx, l.op,
 CASE WHEN l.idx % 89 = 0 THEN 'timeout' WHEN l.idx % 71 = 0 THEN 'wrong_partition' WHEN l.idx % 53 = 0 THEN 'wrong_leader'
      WHEN l.op = 'get' AND s.k IS NULL THEN 'not_found' ELSE 'ok' END AS status
FROM log l LEFT JOIN state s ON s.k = l.k""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    log = views.op_log(spark, d)
    held = fold.fold(oplog.accepted(log)).select("k", F.lit(True).alias("found"))
    rows = log.select("idx", "op", "k").join(held, "k", "left")
    fails = lambda n: F.col("idx") % n != 0
    return rows.select("idx", "op", oplog.response_status(F.col("k"), F.col("found"), F.col("op"), fails(71), fails(53), fails(89)).alias("status"))


@query(
    "model_vs_store",
    f"WITH {views.RANKED_SQL}, {views.fold_sql('accepted')}, cut AS (SELECT k, v FROM state WHERE version <= {AT}) SELECT coalesce(s.k, c.k) AS k, s.v AS expected, c.v AS actual FROM state s FULL JOIN cut c ON s.k = c.k WHERE s.v IS DISTINCT FROM c.v",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    full = state(spark, d)
    return fold.differences(full, full.where(F.col("version") <= AT))


@query("append_conversation", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS v, count(*) AS turns FROM (SELECT DISTINCT * FROM conversations) GROUP BY conv_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct()
    return turns.groupBy("conv_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY turn)").alias("v"), F.count(F.lit(1)).alias("turns"))


@query("blob_put_latest", "SELECT source AS k, max(doc_id) AS version, arg_max(length(text), doc_id)::BIGINT AS chars FROM documents GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("k"), "doc_id", F.length("text").cast("long").alias("chars"))
    return fold.last_write(docs, "k", [F.col("doc_id")], ["doc_id", "chars"]).select("k", F.col("doc_id").alias("version"), "chars")


@query("proposed_entries", f"WITH {views.LOG_SQL}, last AS (SELECT part, max(idx) AS m FROM log GROUP BY part), more AS (SELECT o_orderkey, (o_orderkey % {views.PARTITIONS})::INTEGER AS part FROM orders) SELECT o_orderkey, more.part, m + row_number() OVER (PARTITION BY more.part ORDER BY o_orderkey) AS idx FROM more JOIN last USING (part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(views.PARTITIONS)).cast("int").alias("part"))
    return oplog.proposed(views.op_log(spark, d), new, "o_orderkey").select("o_orderkey", "part", "idx")


# --- memtables, runs and compaction ------------------------------------------------------------------


@query("memtable_last_write", f"WITH {views.WRITES_SQL} SELECT k, is_tombstone, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {', '.join(c + ' DESC' for c in views.VERSION)}) AS nth FROM writes) WHERE nth = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fold.last_write(views.writes(spark, d), "k", [F.col(c) for c in views.VERSION], ["is_tombstone", "v"])


@query("memtable_bytes", f"WITH {views.ENTRIES_SQL} SELECT count(*) AS entries, sum(octet_length(k::BLOB) + coalesce(octet_length(v::BLOB), 0) + 64)::BIGINT AS bytes FROM entries WHERE level = 0 AND run_id = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fold.memtable_bytes(views.entries(spark, d).where("level = 0 and run_id = 1"), "k", "v")


@query("flush_runs", f"WITH {views.ENTRIES_SQL}, n AS (SELECT *, (row_number() OVER (PARTITION BY level, run_id ORDER BY k) - 1) * 4 // count(*) OVER (PARTITION BY level, run_id) AS file FROM entries WHERE level = 0) SELECT level, run_id, file::INTEGER AS file, count(*) AS entries, min(k) AS smallest, max(k) AS largest FROM n GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    cut = runs.split_files(views.entries(spark, d).where("level = 0"), 4)
    return cut.groupBy("level", "run_id", "file").agg(F.count(F.lit(1)).alias("entries"), F.min("k").alias("smallest"), F.max("k").alias("largest"))


_MERGED = f"{views.MANIFEST_SQL}, merged AS (SELECT k, is_tombstone, v, level, run_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, run_id DESC) AS nth FROM entries) WHERE nth = 1)"


@query("merge_runs", f"WITH {_MERGED} SELECT k, is_tombstone, v, level, run_id FROM merged")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.merge(views.entries(spark, d))


@query("live_state", f"WITH {_MERGED} SELECT k, v FROM merged WHERE NOT is_tombstone")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.live(views.entries(spark, d))


@query(
    "merge_tombstones",
    f"""WITH {views.MANIFEST_SQL}, chosen AS (SELECT * FROM entries WHERE level = 0 OR (level = 1 AND run_id <= 1)),
m AS (SELECT k, is_tombstone, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, run_id DESC) AS nth FROM chosen) WHERE nth = 1)
SELECT 1::INTEGER AS level, 99::BIGINT AS run_id, k, is_tombstone, v FROM m
WHERE NOT is_tombstone OR EXISTS (SELECT 1 FROM manifest f WHERE f.level > 1 AND m.k BETWEEN f.smallest AND f.largest)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.entries(spark, d)
    return runs.compact(rows, runs.manifest(rows), [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)], 1, 99)


@query("compaction_overlap", f"WITH {views.MANIFEST_SQL} SELECT a.level, a.run_id, b.run_id AS below_id FROM manifest a JOIN manifest b ON b.level = a.level + 1 AND a.smallest <= b.largest AND b.smallest <= a.largest WHERE a.level = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.overlaps(runs.manifest(views.entries(spark, d)), 1)


@query("compaction_input_range", f"WITH {views.MANIFEST_SQL} SELECT min(smallest) AS smallest, max(largest) AS largest FROM manifest WHERE level = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.input_range(runs.manifest(views.entries(spark, d)).where("level = 1"))


@query("lookup_candidate_files", f"WITH {views.MANIFEST_SQL} SELECT o.k, m.level, m.run_id FROM (SELECT format('k{{:07d}}', o_orderkey) AS k FROM orders) o JOIN manifest m ON o.k BETWEEN m.smallest AND m.largest")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select(F.format_string("k%07d", "o_orderkey").alias("k"))
    return runs.lookup_candidates(keys, runs.manifest(views.entries(spark, d)))


_STATS = f"{views.MANIFEST_SQL}, stats AS (SELECT l.level::INTEGER AS level, count(m.level) AS files, coalesce(sum(m.size), 0)::BIGINT AS bytes FROM (SELECT unnest(range({runs.LEVELS})) AS level) l LEFT JOIN manifest m ON m.level = l.level GROUP BY l.level)"
_SCORES = f"{_STATS}, scores AS (SELECT level, CASE WHEN level = 0 THEN files / 4.0::DOUBLE WHEN level = {runs.LEVELS - 1} THEN 0.0 ELSE bytes / (200000.0::DOUBLE * pow(2.0, level - 1)) END::DOUBLE AS score FROM stats)"


@query("level_stats", f"WITH {_STATS} SELECT level, files, bytes FROM stats")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.level_stats(runs.manifest(views.entries(spark, d)))


@query("level_score", f"WITH {_SCORES} SELECT level, score FROM scores")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.level_scores(runs.manifest(views.entries(spark, d)), l1_bytes=200_000, growth=2)


@query("pick_compaction", f"WITH {_SCORES} SELECT level, score FROM scores WHERE score >= 1 ORDER BY score DESC, level DESC LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.pick_level(runs.level_scores(runs.manifest(views.entries(spark, d)), l1_bytes=200_000, growth=2))


@query("pick_file", f"WITH {views.MANIFEST_SQL} SELECT level, run_id, size, smallest, largest FROM manifest WHERE level = 1 ORDER BY largest <= 'k0005000', smallest, run_id LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.pick_file(runs.manifest(views.entries(spark, d)), 1, "k0005000").select("level", "run_id", "size", "smallest", "largest")


_MOVES = f"{views.SPREAD_SQL}, moves AS (SELECT * FROM spread a WHERE level = 1 AND NOT EXISTS (SELECT 1 FROM spread b WHERE b.level = 2 AND a.smallest <= b.largest AND b.smallest <= a.largest))"


@query("trivial_moves", f"WITH {_MOVES} SELECT level, run_id, size, smallest, largest FROM moves")
def _(spark: SparkSession, d: str) -> DataFrame:
    return runs.trivial_moves(views.spread_files(spark, d), 1).select("level", "run_id", "size", "smallest", "largest")


@query("manifest_after_moves", f"WITH {_MOVES} SELECT (t.level + CASE WHEN m.run_id IS NULL THEN 0 ELSE 1 END)::INTEGER AS level, t.run_id, t.size, t.smallest, t.largest FROM spread t LEFT JOIN moves m ON m.level = t.level AND m.run_id = t.run_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    files = views.spread_files(spark, d)
    return runs.moved(files, runs.trivial_moves(files, 1))


@query(
    "recover_state",
    f"""WITH {_MERGED}, tail AS (SELECT 'k' || lpad((user_id + 1)::VARCHAR, 7, '0') AS k, event_type = 'error' AS dead, event_id FROM events),
newest AS (SELECT k, arg_max(dead, event_id) AS dead, max(event_id) AS e FROM tail GROUP BY k)
SELECT k, 'e' || e AS v FROM newest WHERE NOT dead UNION ALL SELECT k, v FROM merged WHERE NOT is_tombstone AND k NOT IN (SELECT k FROM newest)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    tail = table(spark, d, "events").select(F.format_string("k%07d", F.col("user_id") + 1).alias("k"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("v"), F.col("event_id").alias("idx"))
    return runs.recover(views.entries(spark, d), tail)


@query("bloom_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("missing_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("bloom_probes", "SELECT b::INTEGER AS bits, greatest(1, least(30, floor(b * 0.69)))::INTEGER AS probes FROM (SELECT unnest(range(0, 60)) AS b)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(60).select(F.col("id").cast("int").alias("bits"), bloom.probe_count(F.col("id")).alias("probes"))


# --- hashing and placement ------------------------------------------------------------------------------


def murmur_sql(key: str, seed: int, source: str, to: str = "hashed") -> str:
    """The hash of keys of 8 to 15 bytes, in 128-bit arithmetic: one whole word, then the bytes that are left."""
    m, two64 = f"{hashing.MULTIPLIER}::UHUGEINT", "18446744073709551616::UHUGEINT"

    def shift(x: str) -> str:
        return f"xor({x}, {x} >> {hashing.SHIFT})"

    def times(x: str) -> str:
        low, high = f"(({x}) & 4294967295::UHUGEINT)", f"(({x}) >> 32)"
        return f"(({low} * {m} + ((({high} * {m}) & 4294967295::UHUGEINT) << 32)) % {two64})"

    def word(places: str, first: int) -> str:
        return f"list_reduce(list_prepend(0::UHUGEINT, list_transform({places}, lambda i: ascii(substr({key}, (i + {first})::INTEGER, 1))::UHUGEINT << (8 * i)::UHUGEINT)), lambda a, b: a + b)"

    t = to
    return f"""{t}0 AS (SELECT *, {word('range(8)', 1)} AS w, {word(f'range(length({key}) - 8)', 9)} AS rest, length({key})::UHUGEINT AS bytes FROM {source}), {t}1 AS (SELECT *, {times('w')} AS a FROM {t}0), {t}2 AS (SELECT *, {shift('a')} AS b FROM {t}1),
{t}3 AS (SELECT *, xor(xor({times('bytes')}, {seed}::UHUGEINT), {times('b')}) AS c0 FROM {t}2), {t}4 AS (SELECT *, {times('c0')} AS c1 FROM {t}3), {t}5 AS (SELECT *, xor(c1, rest) AS c2 FROM {t}4),
{t}6 AS (SELECT *, CASE WHEN bytes = 8 THEN c1 ELSE {times('c2')} END AS e FROM {t}5), {t}7 AS (SELECT *, {shift('e')} AS f FROM {t}6), {t}8 AS (SELECT *, {times('f')} AS g FROM {t}7), {to} AS (SELECT *, {shift('g')} AS h FROM {t}8)"""


def _ring_sql(nodes: int, vnodes: int, to: str) -> str:
    names = f"{to}_names AS (SELECT n AS node_id, 'node-' || n || '#' || v AS name FROM (SELECT unnest(range(1, {nodes + 1})) AS n) CROSS JOIN (SELECT unnest(range({vnodes})) AS v))"
    return f"{names}, {murmur_sql('name', hashing.DEFAULT_SEED, f'{to}_names', to + '_h')}, {to} AS (SELECT h::HUGEINT AS point, node_id FROM {to}_h)"


def _owner_sql(ring: str, to: str) -> str:
    return f"{to} AS (SELECT k, coalesce(r.node_id, (SELECT arg_min(node_id, point) FROM {ring})) AS node_id FROM (SELECT k, h::HUGEINT AS h FROM hashed) q ASOF LEFT JOIN {ring} r ON q.h <= r.point)"


_ORDER_KEYS = "keys AS (SELECT o_orderkey, format('k{:07d}', o_orderkey) AS k FROM orders)"


def order_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.format_string("k%07d", "o_orderkey").alias("k"))


@query("hash_partition", f"WITH {_ORDER_KEYS}, {murmur_sql('k', hashing.PARTITION_SEED, 'keys')} SELECT k, (h % {views.PARTITIONS})::INTEGER AS part FROM hashed")
def _(spark: SparkSession, d: str) -> DataFrame:
    return order_keys(spark, d).select("k", hashing.partition_for(F.col("k"), views.PARTITIONS).alias("part"))


@query("hash_unsigned", f"WITH {_ORDER_KEYS}, {murmur_sql('k', hashing.DEFAULT_SEED, 'keys')} SELECT k, h::VARCHAR AS h FROM hashed")
def _(spark: SparkSession, d: str) -> DataFrame:
    return order_keys(spark, d).select("k", hashing.unsigned(hashing.hash64(F.col("k"))).cast("string").alias("h"))


@query("partition_spread", f"WITH {_ORDER_KEYS}, {murmur_sql('k', hashing.PARTITION_SEED, 'keys')} SELECT (h % {views.PARTITIONS})::INTEGER AS part, count(*) AS keys FROM hashed GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return order_keys(spark, d).groupBy(hashing.partition_for(F.col("k"), views.PARTITIONS).alias("part")).agg(F.count(F.lit(1)).alias("keys"))


@query("misrouted_keys", f"WITH {_ORDER_KEYS}, {murmur_sql('k', hashing.PARTITION_SEED, 'keys')} SELECT o_orderkey, k, (o_orderkey % {views.PARTITIONS})::INTEGER AS part FROM hashed WHERE h % {views.PARTITIONS} <> o_orderkey % {views.PARTITIONS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = order_keys(spark, d).withColumn("part", F.pmod("o_orderkey", F.lit(views.PARTITIONS)).cast("int"))
    return oplog.misrouted(rows, views.PARTITIONS)


def placed(spark: SparkSession) -> DataFrame:
    return placement.placement(spark, [1, 2, 3, 4, 5], views.PARTITIONS)


_PLACED = "placed AS (SELECT unnest(range(6))::INTEGER AS part, unnest([[2,3,1],[3,1,2],[2,1,3],[3,1,2],[2,3,1],[2,1,3]]) AS held), replicas AS (SELECT part, unnest(range(3))::INTEGER AS pos, unnest(held)::BIGINT AS node_id FROM placed)"


@query("placement_table", f"WITH {_PLACED} SELECT part, pos, node_id FROM replicas")
def _(spark: SparkSession, d: str) -> DataFrame:
    return placement.placement(spark, [1, 2, 3], views.PARTITIONS)


@query("partitions_on_node", f"WITH {_PLACED} SELECT DISTINCT part FROM replicas WHERE node_id = 2 AND pos = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return placement.partitions_on(placement.placement(spark, [1, 2, 3], views.PARTITIONS).where("pos = 0"), 2)


_LOAD = f"{_ORDER_KEYS}, {murmur_sql('k', hashing.PARTITION_SEED, 'keys')}, {_PLACED}, loads AS (SELECT node_id, count(*) AS keys FROM hashed JOIN replicas ON part = h % {views.PARTITIONS} WHERE pos = 0 GROUP BY node_id)"


def primary_load(spark: SparkSession, d: str) -> DataFrame:
    at = placement.placement(spark, [1, 2, 3], views.PARTITIONS).where("pos = 0")
    return placement.load(placement.route(order_keys(spark, d).select("k"), at, views.PARTITIONS))


@query("node_load", f"WITH {_LOAD} SELECT node_id, keys FROM loads")
def _(spark: SparkSession, d: str) -> DataFrame:
    return primary_load(spark, d)


@query("node_spread", f"WITH {_LOAD} SELECT max(keys) AS most, min(keys) AS least, max(keys) / greatest(min(keys), 1)::DOUBLE AS ratio FROM loads")
def _(spark: SparkSession, d: str) -> DataFrame:
    return placement.spread(primary_load(spark, d))


@query("ring_points", f"WITH {_ring_sql(5, 64, 'ring')} SELECT point::VARCHAR AS point, node_id FROM ring")
def _(spark: SparkSession, d: str) -> DataFrame:
    return placement.ring([1, 2, 3, 4, 5]).frame(spark).select(F.col("point").cast("string").alias("point"), "node_id")


_MOVES = f"{_ORDER_KEYS}, {murmur_sql('k', hashing.DEFAULT_SEED, 'keys')}, {_ring_sql(10, 128, 'ten')}, {_ring_sql(11, 128, 'eleven')}, {_owner_sql('ten', 'before')}, {_owner_sql('eleven', 'after')}"


@query("ring_rebalance", f"WITH {_MOVES} SELECT count(*) AS keys, count(*) FILTER (WHERE before.node_id <> after.node_id) AS moved, count(*) FILTER (WHERE before.node_id <> after.node_id) / count(*)::DOUBLE AS fraction FROM before JOIN after USING (k)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """How many orders' keys change their owner when an eleventh node joins ten."""
    keys = order_keys(spark, d).select("k")
    return placement.moved(placement.owners(keys, placement.ring(list(range(1, 11)), 128)), placement.owners(keys, placement.ring(list(range(1, 12)), 128)))


_PROBES = bloom.probes(bloom.BITS_PER_KEY)
_TURN = "((((h >> 33) | (h << 31)) & 18446744073709551615::UHUGEINT))"
_BLOOM = f"""keys AS (SELECT format('k{{:07d}}', o_orderkey) AS k FROM orders UNION SELECT format('k{{:07d}}', l_orderkey) FROM lineitem), {murmur_sql('k', hashing.BLOOM_SEED, 'keys')},
held AS (SELECT DISTINCT format('k{{:07d}}', l_orderkey) AS k FROM lineitem), width AS (SELECT (greatest(64, count(*) * {bloom.BITS_PER_KEY}) + 7) // 8 * 8 AS bits FROM held),
probed AS (SELECT k, ((h + {_TURN} * i) % 18446744073709551616::UHUGEINT % bits::UHUGEINT)::BIGINT AS place FROM hashed, width, (SELECT unnest(range({_PROBES}))::UHUGEINT AS i) p),
bits AS (SELECT DISTINCT place FROM probed SEMI JOIN held USING (k)), passing AS (SELECT k FROM probed LEFT JOIN bits USING (place) GROUP BY k HAVING count(bits.place) = count(*)),
answers AS (SELECT k, k IN (SELECT k FROM passing) AS maybe, k IN (SELECT k FROM held) AS present FROM (SELECT format('k{{:07d}}', o_orderkey) AS k FROM orders))"""


def filtered_keys(spark: SparkSession, d: str) -> DataFrame:
    """(k, present, maybe) of orders' keys, asked of a bit-exact filter over lineitem's keys."""
    held = table(spark, d, "lineitem").select(F.format_string("k%07d", "l_orderkey").alias("k")).distinct()
    made = bloom.build(held, "k", held.count())
    keys = table(spark, d, "orders").select(F.format_string("k%07d", "o_orderkey").alias("k")).join(held.withColumn("present", F.lit(True)), "k", "left")
    return keys.withColumn("maybe", bloom.contains(made, F.col("k")))


@query("bloom_exact_filter", f"WITH {_BLOOM} SELECT count(*) AS asked, count(*) FILTER (WHERE maybe) AS passed, count(*) FILTER (WHERE present AND NOT maybe) AS false_negatives, count(*) FILTER (WHERE NOT present AND maybe) AS false_positives FROM answers")
def _(spark: SparkSession, d: str) -> DataFrame:
    """How many keys of orders the filter lets through, beside the truth."""
    return filtered_keys(spark, d).agg(
        F.count(F.lit(1)).alias("asked"),
        F.count(F.when(F.col("maybe"), 1)).alias("passed"),
        F.count(F.when(F.col("present") & ~F.col("maybe"), 1)).alias("false_negatives"),
        F.count(F.when(F.col("present").isNull() & F.col("maybe"), 1)).alias("false_positives"),
    )


@query("bloom_skip_share", f"WITH {_BLOOM} SELECT count(*) AS absent, coalesce(count(*) FILTER (WHERE NOT maybe) / nullif(count(*), 0)::DOUBLE, 0) AS skipped FROM answers WHERE NOT present")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of the keys that are not there, the share whose lookup the filter spares."""
    absent, spared = F.count(F.lit(1)), F.count(F.when(~F.col("maybe"), 1))
    return filtered_keys(spark, d).where("present is null").agg(absent.alias("absent"), metrics.ratio(spared, absent).alias("skipped"))


# --- consensus logs -----------------------------------------------------------------------------------------


def acks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.pmod("user_id", F.lit(views.PARTITIONS)).cast("int").alias("part"), F.pmod("event_id", F.lit(views.NODES)).alias("node_id"), F.col("event_id").alias("match_idx"), ms.alias("ack_ms"), F.col("event_id").alias("read_seq"))


_ACKS = f"acks AS (SELECT (user_id % {views.PARTITIONS})::INTEGER AS part, event_id % {views.NODES} AS node_id, event_id AS match_idx, epoch_us(ts) // 1000 AS ack_ms FROM events)"


@query("commit_index", f"WITH {_ACKS}, m AS (SELECT part, node_id, max(match_idx) AS m FROM acks GROUP BY ALL) SELECT part, coalesce(list_sort(list(m), 'DESC')[3], 0) AS commit_index FROM m GROUP BY part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.commit_index(acks(spark, d), views.NODES)


@query("commit_in_term", f"WITH {_ACKS}, m AS (SELECT part, node_id, max(match_idx) AS m FROM acks GROUP BY ALL), c AS (SELECT part, coalesce(list_sort(list(m), 'DESC')[3], 0) AS commit_index FROM m GROUP BY part), e AS (SELECT DISTINCT part, match_idx, match_idx // 2500 + 1 AS entry_term FROM acks) SELECT c.part, c.commit_index, e.entry_term FROM c JOIN e ON e.part = c.part AND e.match_idx = c.commit_index WHERE entry_term = (SELECT max(match_idx) // 2500 + 1 FROM acks)")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = acks(spark, d)
    log = a.select("part", F.col("match_idx").alias("idx"), (F.floor(F.col("match_idx") / 2500) + 1).cast("long").alias("term")).distinct()
    top = a.agg(F.max("match_idx").alias("m")).select((F.floor(F.col("m") / 2500) + 1).cast("long").alias("now"))
    commits = consensus.commit_index(a, views.NODES).join(F.broadcast(top))
    return consensus.committed_in_term(commits, log, F.col("now")).select("part", "commit_index", "entry_term")


def votes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 20).cast("long").alias("term"), F.pmod("user_id", F.lit(3)).alias("candidate"), F.pmod("user_id", F.lit(views.NODES)).alias("voter"), (F.col("event_type") != "error").alias("granted"))


_VOTES = f"votes AS (SELECT event_id // 20 AS term, user_id % 3 AS candidate, user_id % {views.NODES} AS voter, event_type <> 'error' AS granted FROM events)"


@query("vote_tally", f"WITH {_VOTES} SELECT term, candidate, count(DISTINCT voter) FILTER (WHERE granted) AS votes, count(DISTINCT voter) FILTER (WHERE granted) >= 3 AS elected FROM votes GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.vote_tally(votes(spark, d), views.NODES)


@query("leaders_per_term", f"WITH {_VOTES}, t AS (SELECT term, candidate, count(DISTINCT voter) FILTER (WHERE granted) AS n FROM votes GROUP BY ALL) SELECT term, count(DISTINCT candidate) AS leaders FROM t WHERE n >= 3 GROUP BY term")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.leaders_per_term(consensus.vote_tally(votes(spark, d), views.NODES).where("elected").withColumnRenamed("candidate", "node_id"))


_REQUESTS = f"req AS (SELECT user_id % {views.NODES} AS voter, event_id // 10 AS term, event_id % 3 AS candidate, event_id AS asked, event_id // 2500 AS last_term, event_id % 2500 AS last_idx, event_id // 2500 AS own_term, user_id * 7 % 2500 AS own_idx FROM events)"


@query("vote_grants", f"WITH {_REQUESTS}, f AS (SELECT *, (last_term, last_idx) >= (own_term, own_idx) AS fresh FROM req), g AS (SELECT voter, term, arg_min(candidate, asked) AS first FROM f WHERE fresh GROUP BY ALL) SELECT asked, f.voter, f.term, f.candidate, fresh AND coalesce(f.candidate = g.first, false) AS granted FROM f LEFT JOIN g ON g.voter = f.voter AND g.term = f.term")
def _(spark: SparkSession, d: str) -> DataFrame:
    e, n = table(spark, d, "events"), F.col("event_id")
    last = F.floor(n / 2500).cast("long")
    req = e.select(F.pmod("user_id", F.lit(views.NODES)).alias("voter"), F.floor(n / 10).cast("long").alias("term"), (n % 3).alias("candidate"), n.alias("at"), last.alias("last_term"), (n % 2500).alias("last_idx"), last.alias("own_term"), (F.col("user_id") * 7 % 2500).alias("own_idx"))
    return consensus.grants(req).select(F.col("at").alias("asked"), "voter", "term", "candidate", "granted")


@query("quorum_reachability", f"WITH {_ACKS}, n AS (SELECT max(ack_ms) AS now FROM acks), l AS (SELECT part, node_id, max(ack_ms) AS a FROM acks GROUP BY ALL), r AS (SELECT part, count(*) FILTER (WHERE now - a <= {REACH_MS}) + 1 AS reachable FROM l, n GROUP BY part) SELECT part, reachable, reachable >= 3 AS has_quorum FROM r")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = acks(spark, d)
    now = a.agg(F.max("ack_ms")).first()[0] or 0
    return consensus.reachability(a, F.lit(now), views.NODES, REACH_MS)


@query("read_acks", f"WITH {_ACKS}, l AS (SELECT part, node_id, max(match_idx) AS acked FROM acks GROUP BY ALL), q AS (SELECT (n_nationkey % {views.PARTITIONS})::INTEGER AS part, n_nationkey AS read_id, n_nationkey * 401 AS seq FROM nation), c AS (SELECT q.part, read_id, count(DISTINCT node_id) FILTER (WHERE acked >= seq) + 1 AS acks FROM q LEFT JOIN l ON l.part = q.part GROUP BY ALL) SELECT part, read_id, acks, acks >= 3 AS ready FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    reads = table(spark, d, "nation").select(F.pmod("n_nationkey", F.lit(views.PARTITIONS)).cast("int").alias("part"), F.col("n_nationkey").alias("read_id"), (F.col("n_nationkey") * 401).alias("seq"))
    return consensus.read_acks(acks(spark, d), reads, views.NODES)


_LAG = f"WITH {views.REPLICAS_SQL}, g AS (SELECT part, node_id, idx, lag(idx) OVER (PARTITION BY part, node_id ORDER BY idx) AS previous FROM replica_log)"


@query("log_gap_check", f"{_LAG} SELECT part, node_id, idx, previous FROM g WHERE idx <> previous + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.gaps(views.replica_log(spark, d))


@query("log_matching_violations", f"WITH {views.REPLICAS_SQL} SELECT part, idx, count(DISTINCT (term, etype, data)) AS versions FROM replica_log GROUP BY ALL HAVING versions > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.disagreements(views.replica_log(spark, d))


@query("applied_counts", f"WITH {views.REPLICAS_SQL} SELECT part, idx, count(DISTINCT node_id) AS nodes, count(DISTINCT data) AS versions FROM replica_log GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.applied_counts(views.replica_log(spark, d))


@query("first_conflict", f"WITH {views.REPLICAS_SQL} SELECT a.part, min(a.idx) AS conflict_idx FROM replica_log a JOIN replica_log b ON a.part = b.part AND a.idx = b.idx WHERE a.node_id = 0 AND b.node_id = 1 AND a.term <> b.term GROUP BY a.part")
def _(spark: SparkSession, d: str) -> DataFrame:
    log = views.replica_log(spark, d)
    return consensus.first_conflict(log.where("node_id = 0"), log.where("node_id = 1"))


@query("append_entries", f"WITH {views.REPLICAS_SQL}, f AS (SELECT * FROM replica_log WHERE node_id = 1), c AS (SELECT min(a.idx) AS at FROM replica_log a JOIN f ON a.idx = f.idx WHERE a.node_id = 0 AND a.term <> f.term), k AS (SELECT f.* FROM f, c WHERE c.at IS NULL OR f.idx < c.at) SELECT idx, term, data FROM k UNION ALL SELECT idx, term, data FROM replica_log WHERE node_id = 0 AND idx NOT IN (SELECT idx FROM k)")
def _(spark: SparkSession, d: str) -> DataFrame:
    log = views.replica_log(spark, d)
    return consensus.append_entries(log.where("node_id = 0"), log.where("node_id = 1")).select("idx", "term", "data")


@query("follower_commit", f"WITH {views.REPLICAS_SQL}, m AS (SELECT max(idx) AS top FROM replica_log WHERE node_id IN (0, 1)), c AS (SELECT n_nationkey::BIGINT AS n, (n_nationkey * 450 + 5)::BIGINT AS sent, (n_nationkey * 100)::BIGINT AS held FROM nation) SELECT n, greatest(held, least(sent, top)) AS commit_idx FROM c, m")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What a follower commits when leaders with other commit indexes append to it; its log matches to the end once it took their entries."""
    log = views.replica_log(spark, d)
    match = consensus.append_entries(log.where("node_id = 0"), log.where("node_id = 1")).agg(F.max("idx").alias("at"))
    n = F.col("n_nationkey").cast("long")
    asked = table(spark, d, "nation").join(F.broadcast(match))  # one row
    return asked.select(n.alias("n"), consensus.follower_commit(n * 100, n * 450 + 5, F.col("at")).alias("commit_idx"))


@query("conflict_term_start", f"WITH {views.REPLICAS_SQL} SELECT part, node_id, term, min(idx) AS first_idx, max(idx) AS last_idx FROM replica_log WHERE node_id <> 1 GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.conflict_terms(views.replica_log(spark, d).where("node_id <> 1"))


@query("next_index", f"WITH {views.REPLICAS_SQL}, own AS (SELECT part, term, max(idx) AS last_idx FROM replica_log WHERE node_id = 0 GROUP BY ALL), c AS (SELECT 0 AS part, n_nationkey::BIGINT AS conflict_term, (n_nationkey * 450 + 5)::BIGINT AS conflict_idx FROM nation) SELECT c.part, conflict_term, conflict_idx, greatest(1, least(coalesce(last_idx + 1, conflict_idx), (SELECT max(idx) + 1 FROM replica_log WHERE node_id = 0))) AS next_idx FROM c LEFT JOIN own ON own.part = c.part AND own.term = c.conflict_term")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = views.replica_log(spark, d).where("node_id = 0")
    conflicts = table(spark, d, "nation").select(F.lit(0).alias("part"), F.col("n_nationkey").cast("long").alias("conflict_term"), (F.col("n_nationkey") * 450 + 5).cast("long").alias("conflict_idx"))
    last = own.agg(F.max("idx")).first()[0] or 0
    return consensus.next_index(conflicts, consensus.conflict_terms(own), F.lit(last))


@query("log_status", f"WITH {views.REPLICAS_SQL} SELECT part, node_id, max(idx) AS last_idx, arg_max(term, idx) AS last_term, count(*) AS entries FROM replica_log GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.log_status(views.replica_log(spark, d))


@query("max_term", f"WITH {views.REPLICAS_SQL} SELECT part, max(term) AS term FROM replica_log GROUP BY part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.max_term(views.replica_log(spark, d))


@query("ack_by_term", f"WITH {views.REPLICAS_SQL}, p AS (SELECT 0 AS part, event_id + 1 AS idx, (event_id + 1) // 500 + CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END AS term FROM events WHERE event_type <> 'view') SELECT p.part, p.idx, p.term, CASE WHEN a.idx IS NULL THEN 'pending' WHEN a.term = p.term THEN 'ok' ELSE 'wrong_leader' END AS status FROM p LEFT JOIN replica_log a ON a.node_id = 2 AND a.part = p.part AND a.idx = p.idx")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    pending = table(spark, d, "events").where("event_type <> 'view'").select(F.lit(0).alias("part"), (n + 1).alias("idx"), (F.floor((n + 1) / 500) + F.when(n % 13 == 0, 0).otherwise(1)).cast("long").alias("term"))
    return consensus.acknowledge(pending, views.replica_log(spark, d).where("node_id = 2")).select("part", "idx", "term", "status")


@query("rpc_timeouts", "WITH q AS (SELECT event_id AS rpc_id, epoch_us(ts) // 1000 AS sent FROM events), a AS (SELECT event_id AS rpc_id, min(epoch_us(ts) // 1000 + user_id * 3) AS received FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT q.rpc_id, CASE WHEN received - sent <= 1000 THEN received - sent END AS latency, CASE WHEN received - sent <= 1000 THEN 'ok' ELSE 'timeout' END AS status FROM q LEFT JOIN a ON a.rpc_id = q.rpc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    asked = e.select(F.col("event_id").alias("rpc_id"), F.col("ms").alias("sent"))
    answers = e.where("event_type <> 'error'").select(F.col("event_id").alias("rpc_id"), (F.col("ms") + F.col("user_id") * 3).alias("received"))
    return consensus.timeouts(asked, answers, F.lit(1000)).select("rpc_id", "latency", "status")


@query("expired_writes", f"WITH {views.LOG_SQL} SELECT idx, k, idx * 3 + 1000 AS deadline FROM log WHERE op <> 'get' AND idx * 3 + 1000 <= 9000")
def _(spark: SparkSession, d: str) -> DataFrame:
    pending = views.op_log(spark, d).where("op <> 'get'").select("idx", "k", (F.col("idx") * 3 + 1000).alias("deadline"))
    return consensus.expired(pending, F.lit(9000))


@query("heartbeat_gaps", f"WITH {views.BEATS_SQL}, g AS (SELECT node_id, lag(at_ms) OVER (PARTITION BY node_id ORDER BY at_ms) AS previous_ms, at_ms FROM beats) SELECT node_id, previous_ms, at_ms, at_ms - previous_ms AS silence_ms FROM g WHERE at_ms - previous_ms > {ELECTION_MS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.silences(views.beats(spark, d), ELECTION_MS)


@query("session_gaps", f"WITH {views.BEATS_SQL}, g AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY node_id ORDER BY at_ms) > {ELECTION_MS} THEN 1 ELSE 0 END AS new FROM beats), s AS (SELECT *, sum(new) OVER (PARTITION BY node_id ORDER BY at_ms)::BIGINT AS session FROM g) SELECT node_id, session, min(at_ms) AS first_ms, max(at_ms) AS last_ms, count(*) AS beats FROM s GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return consensus.sessions(views.beats(spark, d), ELECTION_MS)


# --- formats and text forms -----------------------------------------------------------------------------------


@query("crc_valid_prefix", "WITH f AS (SELECT source, doc_id, min(CASE WHEN doc_id % 211 = 210 THEN doc_id END) OVER (PARTITION BY source) AS bad FROM documents) SELECT source, count(*) AS records, max(doc_id) AS last FROM f WHERE bad IS NULL OR doc_id < bad GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Documents as framed records, one log for each source; every 211th checksum is wrong."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    framed = docs.withColumn("crc", F.crc32(F.col("text").cast("binary")) + F.when(F.col("doc_id") % 211 == 210, 1).otherwise(0))
    return wal.intact_prefix(framed, ["source"], "doc_id", "crc", "text").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.max("doc_id").alias("last"))


@query("flagged_prefix", "WITH f AS (SELECT source, doc_id, doc_id % 211 <> 210 AS ok FROM documents), p AS (SELECT source, doc_id, bool_and(ok) OVER (PARTITION BY source ORDER BY doc_id) AS whole FROM f) SELECT source, doc_id FROM p WHERE whole")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", (F.col("doc_id") % 211 != 210).alias("good"))
    return wal.intact_prefix_by_flag(rows, ["source"], "doc_id", "good").select("source", "doc_id")


_GROUPS = "CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 16384 THEN printf('%02X%02X', n % 128 + 128, n // 128) WHEN n < 2097152 THEN printf('%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384) ELSE printf('%02X%02X%02X%02X', n % 128 + 128, n // 128 % 128 + 128, n // 16384 % 128 + 128, n // 2097152) END"


@query("varint_roundtrip", f"SELECT n, {_GROUPS} AS bytes, n AS back FROM (SELECT o_orderkey * 37 AS n FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "orders").select((F.col("o_orderkey") * 37).cast("long").alias("n")).withColumn("coded", codecs.varint_bytes(F.col("n")))
    return coded.select("n", F.hex("coded").alias("bytes"), codecs.varint_value(F.col("coded")).alias("back"))


@query("batch_roundtrip", "SELECT doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN 'delete' ELSE 'put' END AS op, 'd' || doc_id AS k, CASE WHEN doc_id % 5 <> 0 THEN coalesce(text, '') END AS v FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Documents as write batches of a log, read back as operations."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), F.when(F.col("doc_id") % 5 != 0, F.coalesce("text", F.lit(""))).alias("v"))
    logged = docs.select(F.lit("documents").alias("path"), F.col("doc_id").alias("pos"), codecs.batch_bytes(F.col("k"), F.col("v")).alias("payload"))
    return wal.operations(logged).select("pos", "op", F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query("key_hex_roundtrip", "SELECT p_partkey, 'k' || lower(hex(p_name::BLOB)) AS text, p_name AS back FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "part").select("p_partkey", text.key_hex(F.col("p_name")).alias("text"))
    return coded.withColumn("back", text.key_from_hex(F.col("text")).cast("string"))


@query("file_name_parse", "WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name ELSE lpad((p_partkey * 997)::VARCHAR, greatest(6, length((p_partkey * 997)::VARCHAR))::INTEGER, '0') || CASE p_partkey % 4 WHEN 1 THEN '.sst' WHEN 2 THEN '.log' ELSE '.tmp' END END AS name FROM part) SELECT p_partkey, name, CASE WHEN regexp_full_match(name, '[0-9]+\\.(sst|log)') THEN regexp_extract(name, '^([0-9]+)', 1)::BIGINT END AS number, CASE WHEN regexp_full_match(name, '[0-9]+\\.(sst|log)') THEN regexp_extract(name, '\\.(sst|log)$', 1) END AS kind FROM n")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, n = table(spark, d, "part"), F.col("p_partkey")
    made = F.when(n % 4 == 0, F.col("p_name")).when(n % 4 == 1, text.file_name(n * 997, "sst")).when(n % 4 == 2, text.file_name(n * 997, "log")).otherwise(text.file_name(n * 997, "tmp"))
    return p.select("p_partkey", made.alias("name")).select("p_partkey", "name", text.file_number(F.col("name")).alias("number"), text.file_kind(F.col("name")).alias("kind"))


@query("host_port_parse", "WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN ':x' ELSE ':' || (page_id * 331) END AS address FROM pages), p AS (SELECT *, CASE WHEN regexp_full_match(address, '.*:[0-9]+') THEN regexp_extract(address, ':([0-9]+)$', 1)::BIGINT END AS n FROM a) SELECT page_id, address, CASE WHEN n <= 65535 THEN regexp_extract(address, '^(.*):[0-9]+$', 1) END AS host, CASE WHEN n <= 65535 THEN n::INTEGER END AS port FROM p")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, n = table(spark, d, "pages"), F.col("page_id")
    tail = F.when(n % 4 == 0, "").when(n % 4 == 1, ":x").otherwise(F.concat(F.lit(":"), (n * 331).cast("string")))
    rows = p.select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), tail).alias("address"))
    return rows.select("page_id", "address", text.host(F.col("address")).alias("host"), text.port(F.col("address")).alias("port"))


@query("key_formats", "SELECT p_partkey, format('key{:016d}', p_partkey) AS bench_key, format('key{:08d}', p_partkey) AS test_key FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.bench_key(F.col("p_partkey")).alias("bench_key"), text.test_key(F.col("p_partkey")).alias("test_key"))


@query("labels_of_codes", "SELECT n_nationkey AS code, coalesce(['get','put','append','delete'][n_nationkey + 1], 'unknown') AS op, coalesce(['ok','not_found','wrong_leader','wrong_partition','timeout','invalid'][n_nationkey + 1], 'unknown') AS status, coalesce(['follower','candidate','leader'][n_nationkey + 1], 'unknown') AS role FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("n_nationkey")
    return table(spark, d, "nation").select(c.alias("code"), text.op_label(c).alias("op"), text.status_label(c).alias("status"), text.role_label(c).alias("role"))


# --- figures -------------------------------------------------------------------------------------------------------


@query("latency_percentiles", "WITH s AS (SELECT event_type, list_sort(list(user_id * 37 + event_id % 1000)) AS l, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, l[floor(0.5 * (n - 1))::BIGINT + 1] AS p50, l[floor(0.99 * (n - 1))::BIGINT + 1] AS p99 FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") * 37 + F.col("event_id") % 1000).alias("us"))
    return metrics.order_statistics(rows, ["event_type"], "us", {"p50": 0.5, "p99": 0.99})


@query("throughput", "WITH t AS (SELECT event_type, count(*) AS ops, sum(octet_length(props::BLOB))::BIGINT AS bytes, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) / 1000.0::DOUBLE AS seconds FROM events GROUP BY 1) SELECT event_type, ops, round(ops / seconds, 9) AS ops_per_s, round(seconds * 1000000 / ops, 3) AS us_per_op, round(bytes / 1048576.0::DOUBLE / seconds, 12) AS mb_per_s FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    seconds = (F.max("ms") - F.min("ms")) / F.lit(1000.0)
    t = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("ops"), F.sum(F.octet_length("props").cast("long")).alias("bytes"), seconds.alias("seconds"))
    rate = metrics.throughput(F.col("ops"), F.col("bytes"), F.col("seconds"))
    return t.select("event_type", "ops", F.round(rate["ops_per_s"], 9).alias("ops_per_s"), F.round(rate["us_per_op"], 3).alias("us_per_op"), F.round(rate["mb_per_s"], 12).alias("mb_per_s"))


@query("mean_latency_by_kind", "SELECT CASE WHEN event_type = 'view' THEN 'read' ELSE 'write' END AS kind, count(*) AS n, sum(user_id * 37 + event_id % 1000) / count(*)::DOUBLE AS mean FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return metrics.mean_by(e, F.when(F.col("event_type") == "view", "read").otherwise("write"), F.col("user_id") * 37 + F.col("event_id") % 1000)


@query("ratio_metrics", f"WITH {views.MANIFEST_SQL} SELECT level, count(*) FILTER (WHERE is_tombstone) / count(*)::DOUBLE AS tombstones, coalesce(sum(octet_length(v::BLOB)), 0) / greatest(sum(octet_length(k::BLOB)), 1)::DOUBLE AS value_to_key FROM entries GROUP BY level")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = views.entries(spark, d)
    n, dead = F.count(F.lit(1)), F.count(F.when(F.col("is_tombstone"), 1))
    values, keys = F.coalesce(F.sum(F.octet_length("v").cast("long")), F.lit(0)), F.sum(F.octet_length("k").cast("long"))
    return e.groupBy("level").agg(metrics.ratio(dead, n).alias("tombstones"), metrics.ratio(values, keys).alias("value_to_key"))


@query("write_amplification", f"WITH {_MERGED} SELECT (SELECT sum(octet_length(k::BLOB) + coalesce(octet_length(v::BLOB), 0)) FROM merged) / (SELECT sum(octet_length(k::BLOB) + coalesce(octet_length(v::BLOB), 0)) FROM writes)::DOUBLE AS amplification")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = lambda df, name: df.agg(F.sum((F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))).cast("long")).alias(name))
    both = size(runs.merge(views.entries(spark, d)), "c").join(size(views.writes(spark, d), "u"))
    return both.select(metrics.write_amplification(F.col("c"), F.col("u")).alias("amplification"))


# a block is held as long as the blocks used since, and itself, fit: each of them is counted at its first use since
_READS = f"""reads AS (SELECT user_id % 8 AS shard, event_id AS seq, 65536 + user_id % 17 AS charge, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
hits AS (SELECT a.shard, a.seq, a.prev IS NOT NULL AND a.charge + coalesce(sum(b.charge), 0) <= {1 << 20} AS hit
  FROM reads a LEFT JOIN reads b ON a.shard = b.shard AND b.seq > a.prev AND b.seq < a.seq AND (b.prev IS NULL OR b.prev < a.prev) GROUP BY a.shard, a.seq, a.prev, a.charge)"""


def replayed(spark: SparkSession, d: str) -> DataFrame:
    """Users' blocks read in the order of events, through a block cache of 8 MB: a cache for each of 8 shards."""
    reads = table(spark, d, "events").select(F.pmod("user_id", F.lit(8)).alias("shard"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), (F.lit(65_536) + F.col("user_id") % 17).alias("charge"))
    return cache.replay(reads, 1 << 20)


@query("cache_replay", f"WITH {_READS} SELECT shard, count(*) AS reads, count(*) FILTER (WHERE hit) AS hits FROM hits GROUP BY shard")
def _(spark: SparkSession, d: str) -> DataFrame:
    return replayed(spark, d).groupBy("shard").agg(F.count(F.lit(1)).alias("reads"), F.count(F.when(F.col("hit"), 1)).alias("hits"))


@query("cache_hit_share", f"WITH {_READS} SELECT count(*) AS reads, count(*) FILTER (WHERE hit) / count(*)::DOUBLE AS share FROM hits")
def _(spark: SparkSession, d: str) -> DataFrame:
    reads = F.count(F.lit(1))
    return replayed(spark, d).agg(reads.alias("reads"), metrics.ratio(F.count(F.when(F.col("hit"), 1)), reads).alias("share"))


@query("cache_recency", "SELECT user_id % 8 AS shard, user_id::VARCHAR AS key, max(event_id) AS last_seq, row_number() OVER (PARTITION BY user_id % 8 ORDER BY max(event_id) DESC)::INTEGER AS rank FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cache.recency(table(spark, d, "events").select(F.pmod("user_id", F.lit(8)).alias("shard"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key")))


# --- histories and faults ----------------------------------------------------------------------------------------------


def checked_history(spark: SparkSession, d: str) -> DataFrame:
    return history.executed(views.requests(spark, d))


@query("linearizable_history", "SELECT true AS ok, NULL::VARCHAR AS bad_key, 0::BIGINT AS unknown_keys")  # the history is one of a correct store
def _(spark: SparkSession, d: str) -> DataFrame:
    return history.summary(history.check(checked_history(spark, d)))


@query("history_stats", f"SELECT count(*) AS ops, count(DISTINCT user_id) AS keys, count(DISTINCT event_id % {views.CLIENTS}) AS clients FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return history.stats(checked_history(spark, d))


def messages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, d, "events").select(n.alias("seq"), F.pmod("user_id", F.lit(5)).alias("src"), (n % 5).alias("dst"), F.unix_millis(F.col("ts").cast("timestamp")).alias("sent_ms"))


@query("fault_delivery_order")
def _(spark: SparkSession, d: str) -> DataFrame:
    return faults.delivery_order(faults.deliver(messages(spark, d), seed=3, groups=[[0, 1, 2], [3, 4]]))


@query("fault_partition_counts", "SELECT CASE WHEN (user_id % 5 < 3) = (event_id % 5 < 3) AND user_id % 5 <> 4 AND event_id % 5 <> 4 THEN 'delivered' ELSE 'cut' END AS status, count(*) AS messages FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return faults.counts(faults.deliver(messages(spark, d), drop_percent=0, groups=[[0, 1, 2], [3, 4]], down=[4]))
