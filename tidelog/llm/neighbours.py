"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Queries and candidates are dealt into row groups and column groups of bounded size; a tile is
a pair of them and one group of a shuffle. In a tile every vector is rounded to int8 codes times a scale of its own. The
product of codes (whole numbers, held exactly by single-precision matrix products of up to 1,024
components) gives an inner product whose error is at most |q^||e_c| + |e_q||c|, with e the rounding
residuals. A candidate survives if its upper bound reaches the greatest of two lower limits: the k-th largest
lower bound in this block, and the k-th best score so far. Survivors are computed again in double precision and
merged into one heap for each query; the tiles' heaps, k rows a query, are merged by rank.
So the answer is exact for any data, and a tile's memory is fixed.

Defined results: vectors that ``usable`` leaves out take no part; equal scores go to the smaller id; a query
with fewer candidates returns all; rows with the query's own id are no candidates.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import table
from tidelog.llm.vectors import dots, matrix, usable

K, ROWS, COLUMNS, BLOCK = 20, 4096, 16_384, 2048
_EXACT = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (whole numbers up to 127, as float32), scales, residual lengths, lengths of the rounded vectors."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(x - near, axis=1), np.linalg.norm(near, axis=1)


def search_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest candidates as (-score, id), in order."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]  # of (score, -id), the worst on top
    cq, sq, eq, nq = quantise(q)
    for lo in range(0, len(cid), BLOCK):
        ids, x = cid[lo : lo + BLOCK], c[lo : lo + BLOCK]
        cc, sc, ec, nc = quantise(x)
        near = np.zeros((len(qid), len(ids)))
        for d in range(0, q.shape[1], _EXACT):
            near += cq[:, d : d + _EXACT] @ cc[:, d : d + _EXACT].T
        near *= sq[:, None] * sc[None, :]
        length = nc + ec
        slack = nq[:, None] * ec[None, :] + eq[:, None] * length[None, :] + 1e-9 * (nq + eq)[:, None] * length[None, :]
        own = qid[:, None] == ids[None, :]
        near[own] = -np.inf
        least = np.full(len(qid), -np.inf)
        if len(ids) > k:
            low = near - slack
            least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k]
        best = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        i, j = np.nonzero((near + slack >= np.maximum(least, best)[:, None]) & ~own)
        for at in range(0, len(i), 1 << 17):
            a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            for row, score, ident in zip(a.tolist(), dots(q[a], x[b]).tolist(), ids[b].tolist(), strict=True):
                heap, item = heaps[row], (score, -ident)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
    return [sorted((-s, -i) for s, i in h) for h in heaps]


def nearest(queries: DataFrame, candidates: DataFrame, d: int, k: int = K, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest candidates of each query, frames as ``usable`` gives them."""
    nq, nc = queries.count(), candidates.count()
    r, g = max(1, -(-nq // rows)), max(1, -(-nc // columns))

    def deal(df: DataFrame, own: int, other: int, kind: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", F.lit("tile")), F.lit(own))
        rest = F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("o")
        both = df.select("id", "x", mine.cast("int").alias("m"), rest)
        return both.select(F.col("o" if kind else "m").alias("r"), F.col("m" if kind else "o").alias("g"), F.lit(kind).alias("kind"), "id", "x")

    def run(part: pa.Table) -> pa.Table:
        kind, ids, x = part["kind"].to_numpy(), part["id"].to_numpy(), matrix(part["x"], d)
        qs, cs = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        qs, cs = qs[np.argsort(ids[qs], kind="stable")], cs[np.argsort(ids[cs], kind="stable")]
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        for lo in range(0, len(qs), 512):
            some = qs[lo : lo + 512]
            for ident, found in zip(ids[some].tolist(), search_tile(ids[some], x[some], ids[cs], x[cs], k) if len(cs) else [], strict=False):
                for s, i in found:
                    out[0].append(ident)
                    out[1].append(i)
                    out[2].append(-s)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    tiles = deal(queries, r, g, 0).union(deal(candidates, g, r, 1))
    found = tiles.groupBy("r", "g").applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, d = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows.where("id % 20 = 0"), rows, d)


SQL = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), d AS (
  SELECT len(x) AS n FROM v GROUP BY len(x) ORDER BY count(*) DESC, len(x) DESC LIMIT 1
), u AS (
  SELECT vec_id, x FROM v WHERE len(x) = (SELECT n FROM d)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
