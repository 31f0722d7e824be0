"""Embedding near-deduplication by counting collisions of one-dimensional projections.

Vectors are scaled to length one and projected on fixed random directions. Along a direction the
difference of two vectors at distance d is normal with deviation d, so the pairs to find
(cosine 0.95: d = 0.316) fall into a window of two deviations centred on the query with probability
0.954. A pair is a candidate if enough of the ``PROJECTIONS`` windows hold it; the count needed is the
largest that a pair at exactly the threshold reaches with probability ``RECALL`` by the
binomial distribution. Candidates are verified by cosine in double precision.

The first projection is sorted into ranges of bounded size; two ranges make a tile if some of their members can lie
within four deviations. In a tile, projections are cells of one byte, so a window test of all pairs is a subtraction
and a comparison of bytes. Equal vectors are one point with a multiplicity, so copies are never compared. A tile
returns for each point the number of links and a spanning forest of its links, not the links; so a dense group of
thousands costs as many rows as it has members.

Defined results: vectors of each length are compared among themselves; a vector that takes no part has no links and is its own component; without vec_id a row is returned
with nulls and links with nothing; rows with the same vec_id are members of their own; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keep, table
from tidelog.llm.graph import components
from tidelog.llm.vectors import dots, matrix, taking_part

COSINE, PROJECTIONS, RECALL, RANGE, LEAD = 0.95, 24, 0.99999, 8192, 4.0
_WINDOW, _CELL, _SIDE = 2.0, 0.036, 1024


def needed(projections: int, recall: float, window: float = _WINDOW) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    p, t, upto = erf(window / sqrt(2)), 0, 0.0
    for t in range(projections + 1):
        upto += comb(projections, t) * p**t * (1 - p) ** (projections - t)
        if upto > 1 - recall:
            break
    return t


def directions(d: int, projections: int) -> np.ndarray:
    """Fixed normal directions (Box and Muller over a hash), alike on every machine and version."""
    n = d * projections
    x = np.arange(2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53) + 1e-17
    return (np.sqrt(-2 * np.log(u[:n])) * np.cos(2 * np.pi * u[n:])).reshape(d, projections)


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tile_links(x: np.ndarray, first: np.ndarray, second: np.ndarray, weight: np.ndarray, cosine: float, count: int, projections: int = PROJECTIONS) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between rows ``first`` and ``second`` of unit vectors x (the same rows: each pair once): weighted degrees and a spanning forest."""
    n, same = len(x), first is second
    distance = sqrt(2 - 2 * cosine)
    p = x @ directions(x.shape[1], projections)
    cell = np.floor(p / _CELL).astype(np.int64).astype(np.uint8)  # wraps: more collisions, never fewer
    reach = int(_WINDOW * distance / _CELL) + 1
    degree, forest, edges = np.zeros(n, np.int64), _Forest(n), []
    for lo in range(0, len(first), _SIDE):
        a = first[lo : lo + _SIDE]
        for at in range(lo if same else 0, len(second), _SIDE):
            b = second[at : at + _SIDE]
            if p[b, 0].min() > p[a, 0].max() + LEAD * distance or p[a, 0].min() > p[b, 0].max() + LEAD * distance:
                continue
            hits = np.zeros((len(a), len(b)), np.uint8)
            for j in range(projections):
                hits += (cell[a, j] + np.uint8(reach))[:, None] - cell[b, j][None, :] <= np.uint8(2 * reach)
            hit = hits >= count
            if same and at == lo:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            for k in range(0, len(i), 1 << 17):
                u, v = a[i[k : k + (1 << 17)]], b[j[k : k + (1 << 17)]]
                ok = dots(x[u], x[v]) >= cosine
                u, v = u[ok], v[ok]
                degree += np.bincount(u, weights=weight[v], minlength=n).astype(np.int64) + np.bincount(v, weights=weight[u], minlength=n).astype(np.int64)
                # most links of a dense group are known: only pairs in different trees are walked through
                roots = np.array([forest.root(r) for r in range(n)]) if len(u) > n else None
                some = np.flatnonzero(roots[u] != roots[v]) if roots is not None else np.arange(len(u))
                for s, t in zip(u[some].tolist(), v[some].tolist(), strict=True):
                    if forest.join(s, t):
                        edges.append((s, t))
    return degree, edges


def links(points: DataFrame, d: int, cosine: float = COSINE, projections: int = PROJECTIONS, recall: float = RECALL, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(id, degree) and (u, v) spanning links of points (id, x, n), n being the number of equal vectors."""
    distance = sqrt(2 - 2 * cosine)
    count = needed(projections, recall)
    lead = directions(d, projections)[:, 0].tolist() if d else []
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    along = F.aggregate(F.zip_with("x", F.array(*map(F.lit, lead)), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) / norm
    placed = keep(points.withColumn("p", along))
    n = placed.count()
    parts = max(1, -(-n // size))
    cuts = placed.agg(F.percentile_approx("p", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    bound = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    ranged = placed.withColumn("g", F.size(F.filter(bound, lambda c: c < F.col("p"))))
    ends = ranged.groupBy("g").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    wide = LEAD * distance
    a = ends.select(F.col("g").alias("ga"), F.col("lo").alias("lo_a"), F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor(F.col("hi") / wide) + 1)).alias("cell"), F.col("hi").alias("hi_a"))
    b = ends.select(F.col("g").alias("gb"), F.col("lo").alias("lo_b"), F.floor(F.col("lo") / wide).alias("cell"))
    near = a.join(b, "cell").where((F.col("ga") <= F.col("gb")) & (F.col("lo_b") <= F.col("hi_a") + wide))
    tiles = near.select("ga", "gb", F.explode(F.array_distinct(F.array("ga", "gb"))).alias("g"))

    def run(part: pa.Table) -> pa.Table:
        ids, x, w, g = part["id"].to_numpy(), matrix(part["x"], d), part["n"].to_numpy(), part["g"].to_numpy()
        x = x / np.sqrt(dots(x, x))[:, None]
        order = np.lexsort((ids, part["p"].to_numpy(), g))
        ids, x, w, g = ids[order], x[order], w[order], g[order]
        one, two = part["ga"][0].as_py(), part["gb"][0].as_py()
        first = np.flatnonzero(g == one)
        second = first if one == two else np.flatnonzero(g == two)
        degree, edges = tile_links(x, first, second, w, cosine, count, projections)
        has = np.flatnonzero(degree)
        u = np.concatenate([ids[has], ids[[e[0] for e in edges]]]).astype(np.int64)
        v = pa.array([None] * len(has) + [int(ids[e[1]]) for e in edges], pa.int64())
        k = pa.array(degree[has].tolist() + [None] * len(edges), pa.int64())
        return pa.table([pa.array(u, pa.int64()), v, k], ["u", "v", "degree"])

    found = keep(ranged.join(tiles, "g").groupBy("ga", "gb").applyInArrow(run, "u long, v long, degree long"))
    degrees = found.where("degree is not null").groupBy(F.col("u").alias("id")).agg(F.sum("degree").alias("degree"))
    return degrees, found.where("v is not null").select("u", "v")


def dedup(vectors: DataFrame, ident: str = "vec_id", col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = taking_part(vectors, ident, col)
    keyed = rows.withColumn("h", F.xxhash64("x")).withColumn("k", F.hash("x"))
    points = keep(keyed.groupBy("x", "h", "k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    made = []
    for d in sorted(r.d for r in points.select(F.size("x").alias("d")).distinct().collect()):  # vectors of different lengths do not link
        made.append(links(points.where(F.size("x") == d).select(F.col("rep").alias("id"), "x", "n"), d, cosine))
    if not made:
        made.append((rows.select("id", F.lit(0).cast("long").alias("degree")), rows.select(F.col("id").alias("u"), F.col("id").alias("v"))))  # no rows
    degrees, edges = (functools.reduce(DataFrame.union, x) for x in zip(*made, strict=True))
    comp = components(edges)
    of = points.select("h", "k", "x", "rep", "n").join(degrees.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("h", "k", F.col("x").alias("y"), (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    linked = keyed.join(of, ["h", "k"]).where("x = y").select("id", "n_links", "component_id")
    rest = vectors.select(F.col(ident).cast("long").alias("id")).exceptAll(rows.select("id")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(rest).select(F.col("id").alias(ident), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {COSINE}
), r AS (
  SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
), c AS (
  SELECT u, least(u, min(w)) AS low FROM r GROUP BY u
), n AS (
  SELECT u, count(*) AS n FROM l GROUP BY u
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.low, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id
"""
