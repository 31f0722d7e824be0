"""Rules of a replicated log as checks and aggregates over recorded logs, acknowledgements and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.operators.ordered import last_before

HEARTBEAT_MS, ELECTION_MS, REACH_MS = 50, 300, 300
DAY_MS = 86_400_000


def quorum(n: Column | int) -> Column:
    """A majority of n."""
    n = F.lit(n) if isinstance(n, int) else n
    return (F.floor(n / 2) + 1).cast("int")


def commit_index(matches: DataFrame, nodes: int) -> DataFrame:
    """(part, commit_index): the greatest index that a majority of the ``nodes`` peers (part, node_id, match_idx) has; 0 without a majority.

    A group has a row for each node after the aggregation, so the sorted list is bounded by the cluster size.
    """
    last = matches.groupBy("part", "node_id").agg(F.max("match_idx").alias("m"))
    ranked = last.groupBy("part").agg(F.sort_array(F.collect_list("m"), asc=False).alias("ms"))
    kth = F.try_element_at("ms", quorum(nodes))
    return ranked.select("part", F.coalesce(kth, F.lit(0).cast("long")).alias("commit_index"))


def committed_in_term(commits: DataFrame, log: DataFrame, term: Column) -> DataFrame:
    """Commit indexes that may be advanced: those whose entry is of the leader's current term."""
    entry = log.select("part", F.col("idx").alias("commit_index"), F.col("term").alias("entry_term"))
    return commits.join(entry, ["part", "commit_index"]).where(F.col("entry_term") == term)


def vote_tally(votes: DataFrame, nodes: int) -> DataFrame:
    """(term, candidate, votes, elected): different voters that granted, against a majority."""
    n = F.count_distinct(F.when(F.col("granted"), F.col("voter")))
    return votes.groupBy("term", "candidate").agg(n.alias("votes")).withColumn("elected", F.col("votes") >= quorum(nodes))


def grants(requests: DataFrame) -> DataFrame:
    """Vote requests (voter, term, candidate, at, last_term, last_idx, own_term, own_idx) with ``granted``.

    A voter grants the first candidate of a term whose log is at least as new as its own, and that candidate again.
    """
    fresh = F.struct("last_term", "last_idx") >= F.struct("own_term", "own_idx")
    first = requests.where(fresh).groupBy("voter", "term").agg(F.min_by("candidate", F.struct("at", "candidate")).alias("__first"))
    return requests.join(first, ["voter", "term"], "left").withColumn("granted", fresh & F.col("candidate").eqNullSafe(F.col("__first"))).drop("__first")


def up_to_date(last_term: Column, last_idx: Column, own_term: Column, own_idx: Column) -> Column:
    return F.struct(last_term, last_idx) >= F.struct(own_term, own_idx)


def reachability(acks: DataFrame, now: Column, nodes: int, within: int = REACH_MS) -> DataFrame:
    """(part, reachable, has_quorum): peers (part, node_id, ack_ms) heard from in the window, and the leader itself."""
    last = acks.groupBy("part", "node_id").agg(F.max("ack_ms").alias("ack_ms"))
    near = F.sum(F.when(now - F.col("ack_ms") <= within, 1).otherwise(0)).cast("long") + 1
    return last.groupBy("part").agg(near.alias("reachable")).withColumn("has_quorum", F.col("reachable") >= quorum(nodes))


def read_acks(acks: DataFrame, reads: DataFrame, nodes: int) -> DataFrame:
    """(part, read_id, acks, ready): peers whose acknowledged read sequence reaches the read's, and the leader itself.

    Peers (part, node_id, read_seq) are first reduced to their greatest sequence: a row for each node.
    """
    last = acks.groupBy("part", "node_id").agg(F.max("read_seq").alias("acked"))
    both = reads.join(last, "part", "left")
    n = F.count_distinct(F.when(F.col("acked") >= F.col("seq"), F.col("node_id"))) + 1
    return both.groupBy("part", "read_id").agg(n.alias("acks")).withColumn("ready", F.col("acks") >= quorum(nodes))


def leaders_per_term(leaders: DataFrame) -> DataFrame:
    """(term, leaders): how many nodes led each term; more than one breaks election safety."""
    return leaders.groupBy("term").agg(F.count_distinct("node_id").alias("leaders"))


def gaps(log: DataFrame) -> DataFrame:
    """Entries that do not follow the entry before on the same replica: (part, node_id, idx, previous)."""
    return last_before(log, ["part", "node_id"], "idx", F.col("idx"), "previous").where(F.col("idx") != F.col("previous") + 1).select("part", "node_id", "idx", "previous")


def disagreements(log: DataFrame) -> DataFrame:
    """(part, idx, versions): indexes at which replicas hold different entries; a grouped count, no self-join."""
    entry = F.struct("term", "etype", "data")
    return log.groupBy("part", "idx").agg(F.count_distinct(entry).alias("versions")).where("versions > 1")


def applied_counts(log: DataFrame) -> DataFrame:
    """(part, idx, nodes, versions): on how many replicas each index was applied, and with how many different entries."""
    return log.groupBy("part", "idx").agg(F.count_distinct("node_id").alias("nodes"), F.count_distinct("data").alias("versions"))


def first_conflict(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """(part, conflict_idx): the first index at which the follower's term differs; its log is cut from there on."""
    a, b = leader.select("part", "idx", F.col("term").alias("lt")), follower.select("part", "idx", F.col("term").alias("ft"))
    return a.join(b, ["part", "idx"]).where("lt <> ft").groupBy("part").agg(F.min("idx").alias("conflict_idx"))


def append_entries(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """The follower's log after it took all of the leader's entries: its prefix up to the first conflict, then the leader's."""
    cut = first_conflict(leader, follower)
    kept = follower.join(cut, "part", "left").where(F.col("conflict_idx").isNull() | (F.col("idx") < F.col("conflict_idx"))).drop("conflict_idx")
    fresh = leader.join(kept.select("part", "idx"), ["part", "idx"], "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def follower_commit(commit: Column, leader_commit: Column, match: Column) -> Column:
    """A follower's commit index after an append: the leader's, but not behind the last entry known to match, and never back."""
    return F.greatest(commit, F.least(leader_commit, match))


def conflict_terms(log: DataFrame) -> DataFrame:
    """(part, node_id, term, first_idx, last_idx): where each term begins and ends; terms never fall in a log, so a group is one stretch."""
    return log.groupBy("part", "node_id", "term").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def next_index(conflicts: DataFrame, leader_terms: DataFrame, last_idx: Column) -> DataFrame:
    """Where a leader sends from after a refusal (part, conflict_term, conflict_idx): behind its own last entry of that term, or the follower's conflict index; within 1 and its last index plus one."""
    own = leader_terms.select("part", F.col("term").alias("conflict_term"), F.col("last_idx").alias("__own"))
    both = conflicts.join(own, ["part", "conflict_term"], "left")
    return both.withColumn("next_idx", F.greatest(F.lit(1), F.least(F.coalesce(F.col("__own") + 1, F.col("conflict_idx")), last_idx + 1))).drop("__own")


def acknowledge(pending: DataFrame, applied: DataFrame) -> DataFrame:
    """Pending writes (part, idx, term, ...) with their status: ok only if the applied entry is of the term of the proposal, pending if nothing was applied there yet."""
    done = applied.select("part", "idx", F.col("term").alias("__term"))
    status = F.when(F.col("__term").isNull(), "pending").when(F.col("__term") == F.col("term"), "ok").otherwise("wrong_leader")
    return pending.join(done, ["part", "idx"], "left").withColumn("status", status).drop("__term")


def timeouts(requests: DataFrame, responses: DataFrame, within: Column) -> DataFrame:
    """Requests (rpc_id, sent, ...) with latency and status: ok, or timeout for no response (rpc_id, received) in time. The first response counts."""
    first = responses.groupBy("rpc_id").agg(F.min("received").alias("received"))
    took = F.col("received") - F.col("sent")
    return requests.join(first, "rpc_id", "left").withColumn("latency", F.when(took <= within, took)).withColumn("status", F.when(took <= within, "ok").otherwise("timeout"))


def expired(pending: DataFrame, now: Column) -> DataFrame:
    """Pending writes whose deadline has passed."""
    return pending.where(F.col("deadline") <= now)


def silences(beats: DataFrame, longest: int = ELECTION_MS) -> DataFrame:
    """Heartbeats (node_id, at_ms) that came more than ``longest`` after the one before: where an election would start."""
    return last_before(beats, ["node_id"], "at_ms", F.col("at_ms"), "previous_ms", stretch=DAY_MS).where(F.col("at_ms") - F.col("previous_ms") > longest).select("node_id", "previous_ms", "at_ms", (F.col("at_ms") - F.col("previous_ms")).alias("silence_ms"))


def sessions(beats: DataFrame, longest: int = ELECTION_MS) -> DataFrame:
    """(node_id, session, first_ms, last_ms, beats): stretches of heartbeats without such a silence."""
    order = Window.partitionBy("node_id").orderBy("at_ms")
    new = F.when(F.col("at_ms") - F.lag("at_ms").over(order) > longest, 1).otherwise(0)
    numbered = beats.withColumn("__new", new).withColumn("session", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("node_id", "session").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.count(F.lit(1)).alias("beats"))


def max_term(status: DataFrame) -> DataFrame:
    return status.groupBy("part").agg(F.max("term").alias("term"))


def log_status(log: DataFrame) -> DataFrame:
    """(part, node_id, last_idx, last_term, entries) of each replica."""
    return log.groupBy("part", "node_id").agg(F.max("idx").alias("last_idx"), F.max_by("term", "idx").alias("last_term"), F.count(F.lit(1)).alias("entries"))
