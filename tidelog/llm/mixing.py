"""Mixing to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on a bounded sample of the table of labels, gives
each document a posterior over the domains. With a document's tokens t and posterior p, its rate r
brings r * t * p[d] expected tokens to domain d. The rates are the nonnegative least-squares
solution of: expected tokens of every domain = target share * all tokens, found by projected
gradient steps from rate one (of all solutions the one that the steps reach, which stays near one).
The residual is measured in the basis that makes the Gram matrix of the documents' contributions
the identity, so that a unit step is a safe one and a few dozen steps are enough.

A rate is a fold of its document's contribution over the residuals so far, so no rate is stored
between steps: a step is one aggregation of a narrow table, and only as many numbers as there are
domains travel. Counts, priors, totals and residuals cover all rows.

Defined results: null texts have no tokens, the prior as posterior, and rate one; without labels
there is one domain, "all", and every rate is one; targets of domains that have no labels are left out and
the rest scaled to one; equal rows get equal rates; a doc_id with several texts is learnt from the least of them; texts of any length are
read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_sample, keep, lists, same_row, table, text_hash, text_parts, word_bounds, word_hashes

BITS = 15
#: Target token shares by domain, quality (q) and toxicity (t) of the table of labels.
TARGETS = {"q1t0": 0.8, "q0t0": 0.12, "q1t1": 0.05, "q0t1": 0.03}


def tokens(col: str = "text") -> Column:
    """Words, runs of characters that are not white space; null: none."""
    return F.coalesce(F.regexp_count(col, F.lit(r"\S+")), F.lit(0)).cast("long")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): one row for each labelled doc_id; rows with a null are left out."""
    named = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return named.groupBy("doc_id").agg(F.min(F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic"))).alias("domain"))


def bags(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word ids, unit weights log(1 + tf), how many by row) of runs of rows."""
    for lo, raw, off in text_parts(col):
        n = len(off) - 1
        starts, stops, row = word_bounds(raw, off)
        ids = (word_hashes(raw, starts, stops) >> np.uint64(64 - BITS)).astype(np.int64)
        cell, tf = np.unique(row * (1 << BITS) + ids, return_counts=True)
        row, w = cell >> BITS, np.log1p(tf)
        size = np.bincount(row, minlength=n)
        length = np.sqrt(np.bincount(row, weights=w * w, minlength=n))
        yield lo, cell & ((1 << BITS) - 1), w / np.maximum(length, 1e-12)[row], size


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def scores(ids: np.ndarray, w: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of weights * W[id] by row, plus the bias in the last row of W."""
    row = np.repeat(np.arange(len(size)), size)
    z = np.stack([np.bincount(row, weights=w * weights[ids, c], minlength=len(size)) for c in range(weights.shape[1])], 1)
    return z + weights[-1]


@dataclass
class Classifier:
    names: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def posterior(self, col: pa.Array) -> np.ndarray:
        out = np.tile(self.prior, (len(col), 1))
        if len(self.names) > 1:
            for lo, ids, w, size in bags(col):
                p = softmax(scores(ids, w, size, self.weights) + np.log(np.maximum(self.prior, 1e-9)))
                out[lo : lo + len(size)] = np.where((size > 0)[:, None], p, self.prior)
        return out


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_per_domain: int = 1000, steps: int = 150, ridge: float = 1e-4) -> Classifier:
    """Fits on at most ``sample_per_domain`` labelled documents of each domain; priors count all of them."""
    named = domains(labels)
    counts = sorted(named.groupBy("domain").count().collect(), key=lambda r: r.domain)
    if not counts:
        return Classifier(["all"], np.ones(1), np.zeros((1, 1)))
    names = [r.domain for r in counts]
    prior = np.array([r["count"] for r in counts], float)
    prior /= prior.sum()
    if len(names) == 1:
        return Classifier(names, prior, np.zeros((1, 1)))
    chosen = bounded_sample(named.withColumnRenamed("doc_id", "__id"), "domain", "__id", sample_per_domain)
    named_texts = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null")
    rows = named_texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most sample_per_domain rows a domain
    rows = rows.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", "text", "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, ids, w, size in bags(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(size)), b.column(2).slice(lo, len(size)), lists(ids.astype(np.int32), size, pa.int32()), lists(w, size, pa.float64())], ["domain", "doc_id", "ids", "w"])

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        y = np.array([names.index(d) for d in pdf["domain"]])
        size = np.array([len(x) for x in pdf["ids"]])
        ids, w = np.concatenate(list(pdf["ids"])), np.concatenate(list(pdf["w"]))
        row, c = np.repeat(np.arange(len(size)), size), len(names)
        weights, speed = np.zeros(((1 << BITS) + 1, c)), np.zeros(((1 << BITS) + 1, c))
        share = 1 / (np.bincount(y, minlength=c)[y] * len(set(y)))  # each domain weighs the same
        for _ in range(steps):
            g = softmax(scores(ids, w, size, weights))
            g[np.arange(len(y)), y] -= 1
            g *= share[:, None]
            step = np.zeros_like(weights)
            for k in range(c):
                step[:-1, k] = np.bincount(ids, weights=w * g[row, k], minlength=1 << BITS)
            step[-1] = g.sum(0)
            speed = 0.9 * speed - 4.0 * (step + ridge * weights)
            weights += speed
        return pd.DataFrame({"w": [weights.astype("<f8").tobytes()]})

    made = rows.mapInArrow(featurise, "domain string, doc_id long, ids array<int>, w array<double>").groupBy(F.lit(0).alias("one")).applyInPandas(descend, "w binary").collect()
    if not made:
        return Classifier(names, prior, np.zeros(((1 << BITS) + 1, len(names))))
    return Classifier(names, prior, np.frombuffer(bytes(made[0].w), "<f8").reshape(-1, len(names)))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, th, tokens, posterior of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def posterior(col: pa.Array) -> pa.Array:
        p = held.value.posterior(col)
        return lists(p.reshape(-1), np.full(len(p), p.shape[1]), pa.float64())

    return docs.select("doc_id", text_hash().alias("th"), tokens().alias("tokens"), posterior.asNondeterministic()(F.lower("text")).alias("posterior"))


def fit_rates(members: DataFrame, names: list[str], targets: dict[str, float], tolerance: float = 1e-6, stored: int = 16, steps: int | None = None) -> tuple[DataFrame, float]:
    """members with ``rate``, by projected gradient on the whitened residual, and the residual that is left: the largest difference of a domain's share from its target.

    Steps go on until the residual is within ``tolerance``, or until ``stored`` steps have not brought it down by a hundredth: then no rates reach the targets.
    ``steps``, where set, is the most of them. Rates are stored every ``stored`` steps, so that a step folds no more residuals than that.
    """
    d = len(names)
    total = members.agg(F.sum("tokens")).first()[0] or 0
    target = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    if not total or not target.sum():
        return members.withColumn("rate", F.lit(1.0)), 0.0
    target /= target.sum()
    share = F.col("tokens") / F.lit(float(total))
    a = keep(members.withColumns({f"__a{j}": share * F.col("posterior")[j] for j in range(d)} | {"rate": F.lit(1.0)}))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = a.agg(*(F.sum(F.col(f"__a{i}") * F.col(f"__a{j}")) for i, j in pairs)).first()
    gram = np.zeros((d, d))
    for (i, j), v in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = v or 0.0
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    past: list[np.ndarray] = []

    def rate() -> Column:
        r = F.col("rate")
        if past:
            h = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in past))
            move = lambda g: sum((F.col(f"__a{j}") * g[j] for j in range(1, d)), F.col("__a0") * g[0])
            r = F.aggregate(h, r, lambda r, g: F.greatest(F.lit(0.0), r - move(g)))
        return r

    worst, before, done = float("inf"), float("inf"), 0
    while True:
        got = a.select(rate().alias("__r"), *(f"__a{j}" for j in range(d))).agg(*(F.sum(F.col("__r") * F.col(f"__a{j}")) for j in range(d))).first()
        residual = np.array([x or 0.0 for x in got]) - target
        worst = float(np.abs(residual).max())
        if worst <= tolerance or steps is not None and done == steps:
            break
        done += 1
        if len(past) == stored:
            if worst > 0.99 * before:
                break
            a, before = keep(a.withColumn("rate", rate())), worst
            past.clear()
        past.append(inverse @ residual)
    return a.withColumn("rate", rate()).drop(*(f"__a{j}" for j in range(d))), worst


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[DataFrame, list[str]]:
    """doc_id, th, tokens, posterior, rate, copies and residual (of the fit) of every row, and the domains' names.

    copies rounds the rate up or down by a hash of the doc_id, so that it is the rate on average.
    """
    model = fit_classifier(docs, labels)
    rates, residual = fit_rates(keep(memberships(docs, model)), model.names, targets)
    dice = F.pmod(F.xxhash64("doc_id", "th", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rates.withColumns({"copies": F.floor(F.col("rate") + dice).cast("long"), "residual": F.lit(residual)}), model.names


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    top = F.array(*(F.lit(n) for n in names))[F.array_position("posterior", F.array_max("posterior")).cast("int") - 1]
    return out.select("doc_id", "tokens", top.alias("domain"), "posterior", "rate", "copies", "residual")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its copies say."""
    out, _ = mix(docs, table(spark, sf_dir, "labels"))
    changed = out.where("copies <> 1").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.min("copies").alias("__copies"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), docs["doc_id"].alias("__d"), text_hash("text").alias("__h"))
    times = F.coalesce(F.col("__copies"), F.lit(1)).cast("int")
    return rows.join(changed, same_row(rows, changed, "__d", "__h", "__id", "__th"), "left").select("r", F.explode(F.array_repeat(F.lit(1), times))).select("r.*")
