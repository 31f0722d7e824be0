"""MinHash near-deduplication with DartMinHash signatures.

A text becomes the set of its shingles of five lower-cased words (a shorter text: one shingle of all
its words). Each shingle owns weight strips, [0, 1), [1, 2), [2, 4) and so on, and in each of them a
random sequence of darts, fixed by hashes of shingle and strip alone: a dart has a rank, which
grows from dart to dart by exponential steps whose rate is the strip's height, a weight inside the strip,
and one of ``coordinates`` coordinates. A dart counts if its weight lies below the shingle's weight.
Of the darts that count, the earliest of each coordinate is kept. Two texts agree on a coordinate with
the probability of their weighted Jaccard similarity. Only darts of rank below (ln k + 4) k / weight
are looked at, about a thousand for a text of any length; where a coordinate stays empty the bound
is doubled, which changes no filled coordinate.

Texts with equal shingle sets, by a 128-bit hash of the whole sorted set, are one node from then on, so copies are never compared. Nodes join on
bands of five coordinates. In each bucket the nodes are compared with its smallest node first; where
the links found leave nodes of a bucket in different components, every pair across these components
follows: as rows in buckets of at most ``SMALL`` nodes; inside tasks, block by block, in larger ones, where
only links that connect components are returned. Every compared pair is verified on its whole shingle sets. Classes are the connected components of verified links.

The production weight of a shingle is one (Jaccard similarity of sets, 0.8 or more); ``classes(weight="count")``
takes the number of its occurrences, and verifies the weighted similarity. With 24 bands of five coordinates a pair at 0.8 meets
with probability 0.99993.

Defined results: a null text, or one without a word, is a class of its own; a row repeated under the same
doc_id is the same document; class_id is the smallest doc_id of the class; texts of any length are read whole; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keep, lists, mix64, same_row, signed, table, text_hash, text_parts, word_bounds, word_hashes
from tidelog.llm.graph import components

WORDS, BANDS, ROWS, SMALL, BLOCK = 5, 24, 5, 32, 4096
_G, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row: (hashes, counts, how many by row)."""
    n = len(off) - 1
    starts, stops, row = word_bounds(raw, off)
    h = word_hashes(raw, starts, stops)
    per_row = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(per_row)])
    grams = np.zeros(0, np.uint64)
    if len(h) >= words:
        grams = h[: len(h) - words + 1].copy()
        for j in range(1, words):
            grams = mix64(grams * _G + h[j : len(h) - words + 1 + j])
    out, counts, sizes = [], [], np.zeros(n, np.int64)
    for i in range(n):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= words:
            got, c = np.unique(grams[lo : hi - words + 1], return_counts=True)
        elif hi > lo:
            got, c = np.array([hi - lo], np.uint64), np.ones(1, np.int64)
            for j in range(lo, hi):
                got = mix64(got * _G + h[j : j + 1])
        else:
            continue
        out.append(got)
        counts.append(c)
        sizes[i] = len(got)
    empty = np.zeros(0, np.uint64)
    return np.concatenate(out) if out else empty, np.concatenate(counts) if counts else empty.astype(np.int64), sizes


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)


def _throw(elem: np.ndarray, row: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts that count with rank up to their row's limit: (row, rank, dart hash)."""
    rows, ranks, darts = [], [], []
    strip, low = 0, 0.0
    left = np.arange(len(elem))
    while len(left):
        height = 1.0 if strip == 0 else low
        key = mix64(elem[left] + np.uint64(strip * int(_G) % (1 << 64)))
        at, rank, j = left, np.zeros(len(left)), 0
        while len(at):
            dart = mix64(key + np.uint64(j * int(_M) % (1 << 64)))
            rank = rank - np.log(_unit(dart)) / height
            ok = rank <= limit[row[at]]
            at, key, rank, dart = at[ok], key[ok], rank[ok], dart[ok]
            below = low + height * _unit(mix64(dart ^ _G)) <= weight[at]
            rows.append(row[at[below]])
            ranks.append(rank[below])
            darts.append(mix64(dart + _G)[below])
            j += 1
        low, strip = low + height, strip + 1
        left = left[weight[left] > low]
    return np.concatenate(rows), np.concatenate(ranks), np.concatenate(darts)


def dart_minhash(elem: np.ndarray, weight: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) signatures of weighted sets given as concatenated elements; rows without weight stay 0."""
    n = len(sizes)
    sig = np.zeros((n, k), np.uint64)
    if not len(elem):
        return sig
    row = np.repeat(np.arange(n), sizes)
    total = np.bincount(row, weights=weight, minlength=n)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n)
    limit[todo] = k * (np.log(k) + 4) / total[todo]
    while len(todo):
        mine = np.isin(row, todo) if len(todo) < n else slice(None)
        at, rank, dart = _throw(elem[mine], row[mine], weight[mine], limit)
        cell = at * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.argsort(rank)[::-1]  # the last value written to a cell, the earliest dart, stays
        flat, filled = sig.reshape(-1), np.zeros(n * k, bool)
        flat[cell[order]] = dart[order]
        filled[cell] = True
        todo = todo[~filled.reshape(n, k)[todo].all(1)]
        limit[todo] *= 2
    return sig


def occurrences(elem: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle as often as it occurs, as elements of their own, so that the sets' similarity is the weighted one; sorted within the row."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row = np.repeat(np.repeat(np.arange(len(sizes)), sizes), count)
    made = mix64(np.repeat(elem, count) + nth.astype(np.uint64) * _G)
    return made[np.lexsort((made, row))], np.bincount(row, minlength=len(sizes))


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weight: str = "presence") -> DataFrame:
    """doc_id, th, s1 and s2 (128-bit hash of the shingle set, null without words), n (the whole weight), band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "s1", "s2", "n", "bands"]
        for b in batches:
            for lo, raw, off in text_parts(b.column(2)):
                m = len(off) - 1
                elem, count, sizes = shingles(raw, off)
                w = count.astype(np.float64) if weight == "count" else np.ones(len(elem))
                sig = dart_minhash(elem, w, sizes, bands * rows).reshape(m, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _G + np.uint64(1), (m, bands)).copy()
                for j in range(rows):
                    key = mix64(key * _M + sig[:, :, j])
                known = np.zeros((2, m), np.uint64)
                held = elem if weight == "presence" else np.stack([elem, count.astype(np.uint64)], 1).reshape(-1)
                step = len(held) // max(len(elem), 1)
                stops = np.cumsum(sizes) * step
                for i in np.flatnonzero(sizes):  # the elements are sorted, so equal sets have equal bytes
                    known[:, i] = np.frombuffer(xxhash.xxh3_128_digest(held[stops[i] - sizes[i] * step : stops[i]].tobytes()), "<u8")
                has = np.where(sizes > 0, bands, 0)
                n = np.bincount(np.repeat(np.arange(m), sizes), weights=w, minlength=m).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, m), b.column(1).slice(lo, m), *(pa.array(signed(known[side]), mask=sizes == 0) for side in (0, 1)), pa.array(n), lists(signed(key[sizes > 0].reshape(-1)), has, pa.int64())], names
                )

    return docs.select("doc_id", text_hash().alias("th"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, th long, s1 long, s2 long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, weight: str = "presence") -> DataFrame:
    """node and its sorted shingle set (with ``weight="count"`` its occurrences) for the rows (doc_id, th, node) of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, raw, off in text_parts(b.column(1)):
                elem, count, sizes = shingles(raw, off)
                if weight == "count":
                    elem, sizes = occurrences(elem, count, sizes)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(sizes)), lists(signed(elem), sizes, pa.int64())], ["node", "items"])

    rows = docs.select("doc_id", text_hash().alias("th"), "text")
    w = wanted.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "node")
    found = rows.join(w, same_row(rows, w, "doc_id", "th", "w_id", "w_th")).dropDuplicates(["node"])
    return found.select("node", F.lower("text").alias("text")).mapInArrow(run, "node long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``parts`` / 100 or more; in whole numbers."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") * (100 + parts) >= (F.size("x") + F.size("y")) * parts).select(F.col("a").alias("u"), F.col("b").alias("v"))


def cross_pairs(items: list[np.ndarray], comp: np.ndarray, parts: int) -> list[tuple[int, int]]:
    """Links that connect different components of the sets ``items``, without those that connect nothing new.

    Overlaps of one set with all others are counted along the lists of sets that hold each of its items. Sets of the
    largest component are connected already and are only compared with the rest.
    """
    size = np.array([len(x) for x in items])
    row = np.repeat(np.arange(len(items)), size)
    _, item = np.unique(np.concatenate(items), return_inverse=True)
    holders, first = row[np.argsort(item, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(item))])
    own = np.concatenate([[0], np.cumsum(size)])
    _, group, members = np.unique(comp, return_inverse=True, return_counts=True)
    found = []
    for x in np.flatnonzero(group != members.argmax()):
        mine = item[own[x] : own[x + 1]]
        spans = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        common = np.bincount(holders[at], minlength=len(items))
        for y in np.flatnonzero((common * (100 + parts) >= (size[x] + size) * parts) & (group != group[x])):
            if group[y] != group[x]:
                found.append((int(x), int(y)))
                group[group == group[y]] = group[x]
    return found


def cross_links(rest: DataFrame, sets: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) across components in large buckets (band, size, node, comp).

    A bucket is dealt into blocks by hash and two blocks at a time are one group, so a task holds at most about two blocks of sets; only links
    that connect components leave it.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp")

    def run(part: pa.Table) -> pa.Table:
        node = part["node"].to_numpy()
        pairs = cross_pairs([x.values.to_numpy() for x in part["items"]], part["comp"].to_numpy(), parts)
        return pa.table([pa.array([node[k[side]] for k in pairs], pa.int64()) for side in (0, 1)], ["u", "v"])

    return keyed.join(sets, "node").select("band", "i", "j", "node", "comp", "items").groupBy("band", "i", "j").applyInArrow(run, "u long, v long")


def classes(docs: DataFrame, similarity: int = 80, bands: int = BANDS, rows: int = ROWS, weight: str = "presence") -> DataFrame:
    """doc_id, th, class_id of each row, and ``first``: whether it is its class's first by doc_id (null last) and th. ``similarity`` in hundredths."""
    s = keep(sketch(docs, bands, rows, weight))
    worded = s.where("s1 is not null")
    alike = worded.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    # numbers are given once and kept; whatever they are, classes are named by doc_id in the end
    nodes = keep(alike.withColumn("node", F.monotonically_increasing_id()))
    band = nodes.select("node", "n", F.explode("bands").alias("band"))
    # kept, so that the join after it is of two plain exchanges, whose hot keys Spark can split
    shared = keep(band.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    met = keep(band.join(shared, "band"))
    wanted = met.select("node").distinct().join(nodes, "node").select("rep.doc_id", "rep.th", "node")
    sets = keep(shingle_sets(docs, wanted, weight))
    first = met.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = keep(verified(first, sets, similarity))
    comp = keep(components(links))
    # buckets that the first links leave in several components
    named = met.join(comp, "node", "left").select("band", "leader", "node", "n", F.coalesce("comp", "node").alias("comp"))
    split = keep(named.groupBy("band").agg(F.count_distinct("comp").alias("parts"), F.count(F.lit(1)).alias("size")).where("parts > 1 and size > 2").select("band", "size"))
    rest = keep(named.join(split, "band").where("node <> leader").drop("leader"))
    small = rest.where(F.col("size") <= SMALL)
    x, y = (small.select("band", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "comp"))) for k in "xy")
    more = (
        x.join(y, "band")
        .where("node_x < node_y and comp_x <> comp_y")
        .where((F.col("n_x") * 100 >= F.col("n_y") * similarity) & (F.col("n_y") * 100 >= F.col("n_x") * similarity))
        .select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
        .distinct()
    )
    late = keep(verified(more, sets, similarity).union(cross_links(rest.where(F.col("size") > SMALL), sets, similarity)))
    if not late.isEmpty():
        comp = keep(components(links.union(late)))
    named = keep(nodes.select("s1", "s2", "node").join(comp, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("class")))
    of = s.select("doc_id", "th", "s1", "s2").join(named, ["s1", "s2"], "left").select("doc_id", "th", "class")
    low = keep(of.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("low")))
    first = F.col("class").isNull() | (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("th") == F.col("low.th")))
    return of.join(low, "class", "left").select("doc_id", "th", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("class_id"), first.alias("first"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays, the first by doc_id (null last) and text hash; of equal ones any. Rows without a word stay, as classes of their own; a repeated row counts once."""
    every = keep(classes(docs))
    gone = every.where("not first").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), docs["doc_id"].alias("__d"), text_hash("text").alias("__h"))
    left = rows.join(gone, same_row(rows, gone, "__d", "__h", "__id", "__th"), "left_anti")
    twice = every.where("first").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        return left.select("r.*")
    again = same_row(left, twice, "__d", "__h", "__id", "__th")
    return left.join(twice, again, "left_anti").select("r.*").union(left.join(twice, again, "left_semi").dropDuplicates(["__d", "__h"]).select("r.*"))
