"""Packing into batches with optimal length buckets.

The histogram of token lengths over all documents has a row for each different length, so it is bounded by the longest
document and not by their number. A dynamic program over it chooses the boundaries of at most ``buckets``
buckets that minimise the padding when every document is padded to its bucket's upper boundary. The
cost of a last bucket is linear in its boundary, so each layer is a lower envelope of lines and takes time in
proportion to the number of lengths. Inside a bucket, documents fill batches of
floor(budget / boundary) documents, at least one.

A bucket may hold most documents, so it is dealt into shards by hash; a shard numbers its documents by
itself, and a running sum of shard sizes (one row for each shard) makes the numbers
global. So only the last batch of a bucket is smaller. Texts are not shuffled.

Defined results: null and empty texts have one token, the end token; a document longer than the budget is a
batch of its own; equal rows are packed as often as they occur; other columns, whatever their names, are not read; no documents give no batches.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import keep, table, text_hash

BUCKETS, BUDGET, SHARD_ROWS = 16, 16_384, 16_384


def token_length(text: str = "text") -> Column:
    """Words and the end token; null counts as empty."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)) + 1).cast("long")


def optimal_boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Upper boundaries, rising, that minimise the sum of boundary - length over all documents."""
    rows = sorted((n, c) for n, c in histogram if c > 0)
    if not rows:
        return []
    length = [n for n, _ in rows]
    cum, mass = [0], [0]
    for n, c in rows:
        cum.append(cum[-1] + c)
        mass.append(mass[-1] + n * c)
    size = len(rows)
    # best[j]: cost of the first j lengths with the layers so far; one bucket first
    best = [0] + [length[j - 1] * cum[j] - mass[j] for j in range(1, size + 1)]
    choices = []
    for _ in range(min(buckets, size) - 1):
        # best'[j] = L[j] * C[j] - M[j] + min over i < j of (best[i] + M[i]) - C[i] * L[j]
        hull: list[int] = []
        value = [b + m for b, m in zip(best, mass, strict=True)]
        new, choice, at = [0] * (size + 1), array("q", bytes(8 * (size + 1))), 0
        for j in range(1, size + 1):
            i = j - 1
            while len(hull) >= 2:
                p, q = hull[-2], hull[-1]
                # q is never below both p and i
                if (value[i] - value[p]) * (cum[q] - cum[p]) <= (value[q] - value[p]) * (cum[i] - cum[p]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            at = min(at, len(hull) - 1)
            x = length[j - 1]
            while at + 1 < len(hull) and value[hull[at + 1]] - cum[hull[at + 1]] * x <= value[hull[at]] - cum[hull[at]] * x:
                at += 1
            i = hull[at]
            new[j], choice[j] = x * cum[j] - mass[j] + value[i] - cum[i] * x, i
        best = new
        choices.append(choice)
    out, j = [], size
    for choice in reversed(choices):
        out.append(length[j - 1])
        j = choice[j]
        if not j:
            break
    if j:
        out.append(length[j - 1])
    return out[::-1]


def bucket_of(n: Column, boundaries: list[int]) -> Column:
    """The bucket's number, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(n <= boundaries[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(boundaries) - 1)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch (from 0 in each bucket), slot, batch_id, pad of every row."""
    rows = keep(docs.select("doc_id", text_hash().alias("th"), (token_length() if length is None else length).alias("n_tokens")))
    histogram = [(r.n_tokens, r.n) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = optimal_boundaries(histogram, buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", *(F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_tokens", "long"), ("batch", "long"), ("slot", "int"), ("batch_id", "string"), ("pad", "long"))))
    held = [0] * len(bounds)
    for n, c in histogram:
        held[bisect_left(bounds, n)] += c
    shards = F.array(*(F.lit(max(1, -(-c // shard_rows))) for c in held))
    bound = F.array(*(F.lit(b).cast("long") for b in bounds))
    dealt = rows.withColumn("bucket", bucket_of(F.col("n_tokens"), bounds))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", F.lit("shard")), shards[F.col("bucket")]))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    own = Window.partitionBy("bucket", "shard").orderBy("doc_id", "th")
    numbered = dealt.withColumn("nth", F.row_number().over(own).cast("long") - 1).join(offset, ["bucket", "shard"]).withColumn("nth", F.col("nth") + F.col("offset"))
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_tokens")).cast("long"))
    out = numbered.withColumn("bucket_tokens", bound[F.col("bucket")]).withColumn("per", per_batch)
    batch = F.floor(F.col("nth") / F.col("per")).cast("long")
    return out.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        batch.alias("batch"),
        F.pmod("nth", "per").cast("int").alias("slot"),
        F.concat_ws("-", F.lpad(F.col("bucket").cast("string"), 2, "0"), batch.cast("string")).alias("batch_id"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("pad"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of the documents that are left, a row for each of them."""
    return pack(docs)
