"""Logs, runs, acknowledgements and histories as views of the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.ordered import numbered

PARTITIONS, CLIENTS, NODES = 6, 7, 5
SPREAD = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as client commands, with a sequence number for each client's writes."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "append").when(F.col("event_type") == "error", "delete").otherwise("put")
    rows = e.select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("k"),
        F.pmod("user_id", F.lit(PARTITIONS)).cast("int").alias("part"),
        F.pmod("user_id", F.lit(CLIENTS)).alias("client_id"),
        op.alias("op"),
        F.concat(F.col("value").cast("decimal(12,2)").cast("string"), F.lit(";")).alias("v"),
    )
    dealt = numbered(rows.withColumn("write", F.col("op") != "get"), ["client_id", "write"], "event_id", "nth")
    return dealt.withColumn("seq", F.when(F.col("write"), F.col("nth"))).drop("write", "nth")


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of those commands: one in fifty attempts is lost, every tenth command is sent again some entries later."""
    c = commands(spark, sf_dir)
    cols = [(F.floor(F.col("event_id") / 2500) + 1).cast("long").alias("term"), "part", "client_id", "seq", "op", "k", "v"]
    sent = c.where("event_id % 50 <> 0").select((2 * F.col("event_id") + 1).alias("idx"), *cols)
    again = c.where("event_id % 10 = 0").select((2 * (F.col("event_id") + 5) + 2).alias("idx"), *cols)
    return sent.union(again)


COMMANDS_SQL = f"""
c0 AS (
  SELECT event_id, 'u' || user_id AS k, (user_id % {PARTITIONS})::INTEGER AS part, user_id % {CLIENTS} AS client_id,
         CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'append' WHEN 'error' THEN 'delete' ELSE 'put' END AS op,
         CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || ';' AS v
  FROM events
), commands AS (
  SELECT *, CASE WHEN op <> 'get' THEN row_number() OVER (PARTITION BY client_id, op <> 'get' ORDER BY event_id) END AS seq FROM c0
)"""
LOG_SQL = f"""{COMMANDS_SQL}, log AS (
  SELECT 2 * event_id + 1 AS idx, event_id // 2500 + 1 AS term, part, client_id, seq, op, k, v FROM commands WHERE event_id % 50 <> 0
  UNION ALL
  SELECT 2 * (event_id + 5) + 2, event_id // 2500 + 1, part, client_id, seq, op, k, v FROM commands WHERE event_id % 10 = 0
)"""
RANKED_SQL = f"""{LOG_SQL}, ranked AS (
  SELECT *, coalesce(max(seq) OVER (PARTITION BY part, client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_seq
  FROM log WHERE op <> 'get'
), accepted AS (SELECT * FROM ranked WHERE seq > last_seq)"""


def fold_sql(source: str) -> str:
    """The fold by a running number of puts and deletes of each key."""
    return f"""epochs AS (
  SELECT *, sum(CASE WHEN op = 'append' THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY idx) AS epoch FROM {source}
), tops AS (
  SELECT *, max(epoch) OVER (PARTITION BY k) AS top FROM epochs
), state AS (
  SELECT k, string_agg(v, '' ORDER BY idx) AS v, max(idx) AS version FROM tops WHERE epoch = top AND op <> 'delete' GROUP BY k
)"""


#: Everything that tells two rows of lineitem apart, newest last.
VERSION = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as writes to orders' keys: small quantities are deletions; level and run are dealt by line number and key."""
    li = table(spark, sf_dir, "lineitem")
    level = F.pmod(F.col("l_linenumber") - 1, F.lit(3)).cast("int")
    run = F.when(level == 0, F.pmod("l_suppkey", F.lit(4))).otherwise(F.floor(F.col("l_orderkey") / F.when(level == 1, 4000).otherwise(1000)).cast("long"))
    dead = F.col("l_quantity") < 6
    return li.select(
        level.alias("level"),
        run.cast("long").alias("run_id"),
        F.format_string("k%07d", "l_orderkey").alias("k"),
        dead.alias("is_tombstone"),
        F.when(~dead, F.concat(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string"))).alias("v"),
        *VERSION,
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run entries (level, run_id, k, is_tombstone, v): the newest write of each key in each run."""
    w = writes(spark, sf_dir)
    newest = F.max_by(F.struct("is_tombstone", "v"), F.struct(*VERSION))
    return w.groupBy("level", "run_id", "k").agg(newest.alias("e")).select("level", "run_id", "k", "e.is_tombstone", "e.v")


WRITES_SQL = f"""w0 AS (
  SELECT *, ((l_linenumber - 1) % 3)::INTEGER AS level, l_quantity < 6 AS is_tombstone FROM lineitem
), writes AS (
  SELECT level, CASE level WHEN 0 THEN l_suppkey % 4 WHEN 1 THEN l_orderkey // 4000 ELSE l_orderkey // 1000 END AS run_id,
         format('k{{:07d}}', l_orderkey) AS k, is_tombstone,
         CASE WHEN NOT is_tombstone THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || '/' || l_suppkey END AS v, {", ".join(VERSION)}
  FROM w0
)"""
ENTRIES_SQL = f"""{WRITES_SQL}, entries AS (
  SELECT level, run_id, k, is_tombstone, v FROM (
    SELECT *, row_number() OVER (PARTITION BY level, run_id, k ORDER BY {", ".join(c + " DESC" for c in VERSION)}) AS nth FROM writes) WHERE nth = 1
)"""
MANIFEST_SQL = f"""{ENTRIES_SQL}, manifest AS (
  SELECT level, run_id, sum(octet_length(k::BLOB) + coalesce(octet_length(v::BLOB), 0))::BIGINT AS size, min(k) AS smallest, max(k) AS largest
  FROM entries GROUP BY level, run_id
)"""


def spread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest in which files of level 1 lie between those of level 2, but for one block of keys in six, where they meet; of all rows of lineitem."""
    block = F.floor(F.substring("k", 2, 7).cast("long") / SPREAD)
    below = (block % 3 == 0) | ((block % 6 == 1) & (F.col("l_linenumber") == 1))
    w = writes(spark, sf_dir).withColumns({"level": F.when(below, 2).otherwise(1), "run_id": block})
    newest = w.groupBy("level", "run_id", "k").agg(F.max_by("v", F.struct(*VERSION)).alias("v"))
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    return newest.groupBy("level", "run_id").agg(F.sum(size.cast("long")).alias("size"), F.min("k").alias("smallest"), F.max("k").alias("largest"))


SPREAD_SQL = f"""{WRITES_SQL}, s0 AS (
  SELECT substr(k, 2)::BIGINT // {SPREAD} AS run_id, k, v, {", ".join(VERSION)} FROM writes
), s1 AS (
  SELECT *, CASE WHEN run_id % 3 = 0 OR (run_id % 6 = 1 AND l_linenumber = 1) THEN 2 ELSE 1 END::INTEGER AS level FROM s0
), s2 AS (
  SELECT *, row_number() OVER (PARTITION BY level, run_id, k ORDER BY {", ".join(c + " DESC" for c in VERSION)}) AS nth FROM s1
), spread AS (
  SELECT level, run_id, sum(octet_length(k::BLOB) + coalesce(octet_length(v::BLOB), 0))::BIGINT AS size, min(k) AS smallest, max(k) AS largest FROM s2 WHERE nth = 1 GROUP BY level, run_id
)"""


def replica_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as three replicas' logs: now and then a replica misses an entry or holds another one."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("etype"))
    node = F.explode(F.array(*(F.lit(n).cast("long") for n in range(3)))).alias("node_id")
    rows = e.select(F.lit(0).alias("part"), node, (F.col("event_id") + 1).alias("idx"), "etype")
    odd = (F.col("idx") % 97 == 0) & (F.col("node_id") == 1)
    kept = rows.where(~((F.col("idx") % 101 == 0) & (F.col("node_id") == 2)))
    term = (F.floor(F.col("idx") / 500) + F.when(odd, 2).otherwise(1)).cast("long")
    data = F.when(odd, F.concat(F.lit("x"), F.col("idx").cast("string"))).otherwise(F.concat(F.lit("d"), F.col("idx").cast("string")))
    return kept.select("part", "node_id", "idx", term.alias("term"), "etype", data.alias("data"))


REPLICAS_SQL = """r0 AS (
  SELECT 0 AS part, n.node_id, event_id + 1 AS idx, event_type AS etype FROM events CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS node_id) n
), replica_log AS (
  SELECT part, node_id, idx, idx // 500 + CASE WHEN idx % 97 = 0 AND node_id = 1 THEN 2 ELSE 1 END AS term, etype,
         CASE WHEN idx % 97 = 0 AND node_id = 1 THEN 'x' ELSE 'd' END || idx AS data
  FROM r0 WHERE NOT (idx % 101 = 0 AND node_id = 2)
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests of seven clients (client, n, op, k, input), each in the order of its events."""
    c = commands(spark, sf_dir)
    return c.select(F.pmod("event_id", F.lit(CLIENTS)).cast("int").alias("client"), F.col("event_id").alias("n"), "op", "k", F.when(F.col("op").isin("put", "append"), F.col("v")).otherwise("").alias("input"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as heartbeats (node_id, at_ms); of a node's beats in the same millisecond one counts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.pmod("user_id", F.lit(NODES)).alias("node_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")).distinct()


BEATS_SQL = f"beats AS (SELECT DISTINCT user_id % {NODES} AS node_id, epoch_us(ts) // 1000 AS at_ms FROM events)"
