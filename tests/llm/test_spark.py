"""Corpus operators on Spark: awkward rows, brute-force results, the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import assert_same, connect
from tidelog.llm import common, embedding_dedup, language_id, line_dedup, mixing, near_dedup, neighbours, packing, pii, suffix_dedup, token_files
from tidelog.llm import queries as corpus
from tidelog.llm.common import bounded_sample, keep, shared_dir
from tidelog.llm.graph import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, rate int"
EN = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree"
DE = "der schnelle braune fuchs springt über den faulen hund und sieben weise eulen sehen ihm dabei zu"


def docs(spark, texts, langs=None):
    """Rows with columns whose names clash with results; doc_ids from 1, the last row without one."""
    rows = [(i + 1, t, (langs or [None] * len(texts))[i], "s", None if t is None else len(t), "mine", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None, None, "mine", 7)], DOCS)


AWKWARD = [None, "", " \n\t ", "one", EN, EN, DE, "x" * 30_000, "a b " * 5000, "\n" * 50, "é€𝄞 " * 40, EN + "\n" + EN]


@pytest.fixture(scope="module")
def awkward(spark):
    df = keep(docs(spark, AWKWARD, [None, "en", "en", "en", "en", "en", "de", None, "en", "de", "de", "en"]))
    return keep(df.union(df.where("doc_id = 5")))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((4, 0, 0), (5, 1, 0), (7, 1, 1), (7, 1, 0), (9, 0, 0), (11, 1, None), (None, 1, 1))):
    return spark.createDataFrame(list(rows), LABELS)


# --- helpers -----------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    for n, m in ((1, 0), (30, 20), (200, 180), (60, 59)):
        pairs = [(i, i + 1) for i in range(m)] if n == 60 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        forest = embedding_dedup._Forest(n)
        for a, b in pairs:
            forest.join(a, b)
        got = {r.node: r.comp for r in components(spark.createDataFrame([*pairs, (None, 1)], "u long, v long")).collect()}
        assert got == {i: forest.root(i) for p in pairs for i in p if p[0] != p[1]}


def test_bounded_sample(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 20, "b").otherwise("c").alias("g"))
    got = {r.g: r["count"] for r in bounded_sample(df, "g", "id", 100).groupBy("g").count().collect()}
    assert got == {"a": 100, "b": df.where("g = 'b'").count(), "c": 100}


def test_shared_folder_is_set(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_release(spark, monkeypatch):
    monkeypatch.setattr(common, "_KEPT", [])
    df = keep(spark.range(3))
    assert df.count() == 3 and common.release(spark) == 1 and common.release(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0]).count()


# --- language -------------------------------------------------------------------------------------------------


def test_language(spark, awkward, none):
    model = language_id.fit(awkward)
    rows = language_id.identify(awkward, model).collect()
    assert len(rows) == len(AWKWARD) + 2
    by = {r.doc_id: r for r in rows}
    for i in (None, 1, 2, 3, 10):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[5].lang_pred == "en" and by[7].lang_pred == "de" and not by[5].rejected and by[None].held_out is False
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id)
    assert language_id.identify(none, language_id.fit(none)).collect() == []
    assert {r.lang_pred for r in language_id.identify(awkward, language_id.fit(none)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    got = language_id.query(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


# --- lines ------------------------------------------------------------------------------------------------------


def lines_of(rows, min_words):
    """Plain form of the rule: rows of (doc_id, text) in order of doc_id."""
    seen, out = {}, {}
    for doc, text in rows:
        parts = text.split("\n")
        units = [i for i, x in enumerate(parts) if x.split()]
        gone = set()
        for a in range(len(units)):
            words = 0
            for b in range(a, len(units)):
                words += len(parts[units[b]].split())
                if words >= min_words:
                    body = tuple(parts[units[k]] for k in range(a, b + 1))
                    rest = [parts[units[k]] for k in range(b + 1, len(units))]
                    if body in seen:  # on to the right, with less than a window's words behind the first line
                        words -= len(parts[units[a]].split())
                        for x, y in zip(rest, seen[body], strict=False):
                            words += len(x.split())
                            if x != y or words >= min_words:
                                break
                            b += 1
                        gone.update(range(units[a], units[b] + 1))
                    seen.setdefault(body, rest)
                    break
        out[doc] = "\n".join(x for i, x in enumerate(parts) if i not in gone)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lines_equal_plain_rule(spark, seed):
    rng = random.Random(seed)
    pool = ["", "a", "b c", "d e f", "g h i j", "k l m n o p", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    df = spark.createDataFrame([(i, t, None, None, len(t), "c", 1) for i, t in rows], DOCS)
    got = {r.id: r.left for r in line_dedup.dedup(df, 6).select(F.col("r.doc_id").alias("id"), "left").collect()}
    assert got == lines_of(rows, 6)


def test_lines_behind_a_long_line_go_with_it(spark):
    """The short lines behind a matched window go as far as they equal those behind the first occurrence."""
    long = "a line that holds more than eight words by itself"
    rows = [(1, f"{long}\nRead more\nof this\nend"), (2, f"start\n{long}\nRead more\nelse"), (3, f"{long}\n\nRead more\nof this\nnew one")]
    df = spark.createDataFrame([(i, t, None, None, len(t), "c", 1) for i, t in rows], DOCS)
    got = {r.id: r.left for r in line_dedup.dedup(df).select(F.col("r.doc_id").alias("id"), "left").collect()}
    assert got == {1: rows[0][1], 2: "start\nelse", 3: "new one"} == lines_of(rows, 8)


def test_winnowing_keeps_few_places_and_loses_no_window(spark):
    """Of many short lines only the selected minima are rows; every window belongs to one of them."""
    rng = random.Random(5)
    rows = [(i, "\n".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(5)]
    df = spark.createDataFrame([(i, t, None, None, len(t), "c", 1) for i, t in rows], DOCS)
    places = {(r.doc_id, r.fp, r.fp_pos) for r in line_dedup.fingerprints(df, 8).collect()}
    assert len(places) < 0.35 * 5 * 400
    w = line_dedup.windows(df, 8).collect()
    assert len(w) == 5 * (400 - 7) and {(r.doc_id, r.fp) for r in w} == {(d, fp) for d, fp, _ in places}
    assert all(any((r.doc_id, r.fp, k) in places for k in range(r.pos, r.last + 1)) for r in w)


def test_lines_awkward(spark, awkward, none):
    rows = line_dedup.dedup(awkward).select("r.*", "n_lines", "n_removed", "left").collect()
    assert len(rows) == len(AWKWARD) + 2 and all(r.class_id == "mine" for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].left is None and by[1].n_lines == 0 and by[2].left == "" and by[2].n_lines == 1
    assert by[5].left == EN and by[6].left == "" and by[6].n_removed == 1 and by[12].left == ""
    out = line_dedup.stage(spark, awkward, DATA)
    assert out.columns == awkward.columns and {6, 12} & {r.doc_id for r in out.collect()} == set()
    assert out.count() == len(AWKWARD) and line_dedup.stage(spark, none, DATA).count() == 0


def test_lines_stay_in_the_jvm(spark):
    plan = line_dedup.query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- near duplicates ------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([" ".join(w)]) if w else frozenset())


def plain_classes(texts):
    sets = [shingle_set(t) for t in texts]
    forest = embedding_dedup._Forest(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                forest.join(i, j)
    return [forest.root(i) for i in range(len(texts))]


def edited(rng, words, share):
    return " ".join(rng.choice(["u", "v", "w"]) + str(rng.randrange(9999)) if rng.random() < share else w for w in words)


def near_texts(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        out += [edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.1])) for _ in range(n // 4)]
    return out


@pytest.mark.parametrize("limits", [(32, 4096), (2, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(near_dedup, "SMALL", limits[0])
    monkeypatch.setattr(near_dedup.cross_links, "__defaults__", (limits[1],))
    texts = near_texts(11)
    df = docs(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    want = plain_classes(texts)
    assert [got[i + 1] for i in range(len(texts))] == [w + 1 for w in want] and got[None] is None


def test_near_duplicates_awkward(spark, awkward, none):
    rows = near_dedup.classes(awkward).collect()
    by = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(AWKWARD) + 2 and by[5] == by[6] == 5 and by[1] == 1 and by[2] == 2 and by[3] == 3 and by[7] == 7
    out = near_dedup.stage(spark, awkward, DATA)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == awkward.columns and 6 not in ids and ids.count(5) == 1 and ids.count(None) == 1
    assert near_dedup.stage(spark, none, DATA).count() == 0 and near_dedup.classes(none).count() == 0


def weighted_jaccard(a, b):
    from collections import Counter

    def grams(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    x, y = grams(a), grams(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_counts_as_weights(spark):
    """Texts with equal shingle sets and unequal counts are one class by presence, and by counts only where the weighted similarity allows it."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(1000)}" for _ in range(60)]
        texts += [" ".join(w), " ".join(w * 2 + w[:4]), " ".join(w + w[:6]), " ".join(w[:-2] + ["x", "y"])]
    df = spark.createDataFrame([(i, t, None, None, len(t), "c", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df, weight="count").collect()}
    forest = embedding_dedup._Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if weighted_jaccard(texts[i], texts[j]) >= 0.8:
                forest.join(i, j)
    assert got == {i: forest.root(i) for i in range(len(texts))} and len(set(got.values())) > 12
    assert len({r.class_id for r in near_dedup.classes(df).collect()}) < len(set(got.values()))


def test_rejection_takes_junk_and_spares_prose(spark):
    """With a sample of production size: documents, and texts in no learnt language; without the floors nothing but letterless text would be rejected."""
    sf = "/root/testdata/sf0.1"
    rows = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    words = [(r.rejected, (r.text or "").split()) for r in rows]
    junk = [gone for gone, w in words if len(w) >= 100 and len(set(w)) <= 12]
    prose = [gone for gone, w in words if len(set(w)) >= 40]
    assert len(junk) >= 5 and sum(junk) >= 0.7 * len(junk)
    assert len(prose) > 500 and sum(prose) <= 0.005 * len(prose)
    rng = random.Random(2)
    model = language_id.fit(language_id.training_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    alien = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k)) for k in (600, 6000, 60_000)] + ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(k)) for k in (600, 60_000)]
    assert model.predict(alien)[2].all()


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    out, names = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = out.collect()
    p, t, r = np.array([x.posterior for x in rows]), np.array([x.tokens for x in rows]), np.array([x.rate for x in rows])
    want = np.array([mixing.TARGETS[n] for n in names])
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and np.abs((p * (t * r)[:, None]).sum(0) / t.sum() - want / want.sum()).max() < 1e-6
    assert abs(sum(x.copies for x in rows) - r.sum()) < 5 * np.sqrt(len(rows))


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(0)
    p, t = rng.dirichlet([0.2, 0.2, 0.2], 60), rng.integers(1, 50, 60)
    df = spark.createDataFrame([(i, 0, int(t[i]), p[i].tolist()) for i in range(60)], "doc_id long, th long, tokens long, posterior array<double>")
    got = np.array([r.rate for r in mixing.fit_rates(df, ["a", "b", "c"], {"a": 0.7, "b": 0.3}, 0.0, 10, 25)[0].orderBy("doc_id").collect()])
    a, b, r = p * (t / t.sum())[:, None], np.array([0.7, 0.3, 0]), np.ones(60)
    inverse = np.linalg.pinv(a.T @ a, rcond=1e-9, hermitian=True)
    for _ in range(25):
        r = np.maximum(0, r - a @ (inverse @ (a.T @ r - b)))
    assert np.allclose(got, r, atol=1e-9) and (r == 0).any()


def test_mixing_awkward(spark, awkward, none):
    for df, lab in ((awkward, labels(spark)), (awkward, labels(spark, [])), (none, labels(spark)), (awkward, labels(spark, [(5, 1, 0)]))):
        out, names = mixing.mix(df, lab)
        rows = out.collect()
        assert len(rows) == df.count() and all(len(r.posterior) == len(names) and r.rate >= 0 and r.copies >= 0 for r in rows)
    clash = awkward.withColumns({"domain": F.lit("q1t0"), "tokens": F.lit(3), "posterior": F.lit("p"), "__id": F.lit(0)})
    same = lambda df: sorted((str(r.doc_id), r.th, r.rate, r.residual) for r in mixing.mix(df, labels(spark))[0].collect())
    assert same(clash) == same(awkward)
    again = {(r.doc_id, r.rate) for r in mixing.mix(awkward, labels(spark))[0].where("doc_id = 5").collect()}
    assert len(again) == 1


def test_mixing_learns_what_it_scores(spark):
    texts = ["ALPHA words", "beta words"] * 6
    lab = labels(spark, [(i + 1, (i + 1) % 2, 0) for i in range(10)])
    lower = docs(spark, [t.lower() for t in texts])
    models = [mixing.fit_classifier(df, lab) for df in (docs(spark, texts), lower)]
    assert np.allclose(models[0].weights, models[1].weights)
    by = {r.doc_id: r.posterior for r in mixing.memberships(docs(spark, [*texts, "alpha WORDS"]), models[0]).collect()}
    assert np.allclose(by[13], by[1]) and max(by[1]) > 0.9 and max(by[2]) > 0.9 and np.argmax(by[1]) != np.argmax(by[2])


# --- packing ------------------------------------------------------------------------------------------------------------


def check_packing(rows, budget):
    batches: dict[str, list] = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens and r.pad == r.bucket_tokens - r.n_tokens
        batches.setdefault(r.batch_id, []).append(r)
    short: dict[int, int] = {}
    for group in batches.values():
        per = max(1, budget // group[0].bucket_tokens)
        assert sorted(r.slot for r in group) == list(range(len(group))) and len(group) <= per
        short[group[0].bucket] = short.get(group[0].bucket, 0) + (len(group) < per)
    assert all(n <= 1 for n in short.values())


def test_packing(spark, awkward, none):
    got = packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), shard_rows=9, budget=2000).collect()
    check_packing(got, 2000)
    bounds = sorted({r.bucket_tokens for r in got})
    hist: dict[int, int] = {}
    for r in got:
        hist[r.n_tokens] = hist.get(r.n_tokens, 0) + 1
    assert bounds == packing.optimal_boundaries(sorted(hist.items()), packing.BUCKETS)
    rows = packing.pack(awkward).collect()
    check_packing(rows, packing.BUDGET)
    assert len(rows) == len(AWKWARD) + 2 and {r.n_tokens for r in rows if r.doc_id in (None, 1, 2, 3)} == {1}
    assert packing.pack(none).count() == 0


# --- repeated strings ------------------------------------------------------------------------------------------------------


def plain_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        mask = np.cumsum(cover)[:-1] > 0
        spans = int((mask[1:] & ~mask[:-1]).sum() + (len(mask) > 0 and mask[0]))
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        out.append((len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [50_000, 2])
def test_repeated_strings_equal_brute_force(spark, most):
    rng = random.Random(most)
    shared = ["".join(rng.choice("abcé ") for _ in range(90)) for _ in range(5)]
    texts = [None, "", "a" * 200, "é" * 100]
    for _ in range(40):
        parts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))]
        for _ in range(rng.randrange(3)):
            s = list(rng.choice(shared))
            if rng.random() < 0.5:
                s[rng.randrange(90)] = "X"
            parts += ["".join(s), "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))]
        texts.append("".join(parts))
    texts.append(texts[-1])
    df = docs(spark, texts)
    found = suffix_dedup.cut_out(df, suffix_dedup.repeats(df, 40, 10, most)).select("r.*", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    want = plain_cut(texts, 40)
    assert [got[i + 1] for i in range(len(texts))] == want and got[None] == (0, 0, 0, hashlib.sha256(b"").hexdigest())


def test_large_collections_are_cut_without_loss(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, near = word(14), word(30)
    # one passage in contexts that agree for a while, on one side or both, so that halves stay large for some rounds
    texts = [word(12) + near[: rng.randrange(31)] + core + near[: rng.randrange(31)] + word(12) for _ in range(120)]
    df = docs(spark, texts)
    want = [x[1:] for x in plain_cut(texts, 30)]
    for most in (3, 40, 50_000):
        rows = suffix_dedup.cut_out(df, suffix_dedup.repeats(df, 30, 6, most)).select("r.doc_id", "n_removed", "n_spans", "kept_sha256").collect()
        got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
        assert [got[i + 1] for i in range(len(texts))] == want


def test_strings_of_periodic_texts_are_few(spark):
    texts = ["a" * 20_000, "ab" * 9_000, "the same sentence again. " * 800, "x" * 300 + "y" * 500]
    df = docs(spark, texts)
    rows = suffix_dedup.members(df, 100, 25)
    assert rows.count() < 300 and rows.agg(F.sum("times")).first()[0] > 10_000
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_out(df, suffix_dedup.repeats(df, 100, 25)).select("r.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[i + 1] for i in range(len(texts))] == plain_cut(texts, 100)


def test_repeated_strings_awkward(spark, awkward, none):
    df = keep(awkward.withColumn("text", F.when(F.col("doc_id") == 5, F.repeat("text", 6)).otherwise(F.col("text"))))
    rows = suffix_dedup.cut_out(df, suffix_dedup.repeats(df)).select("r.doc_id", "n_bytes", "n_removed").collect()
    # the row that occurs twice is a copy of itself, and 30,000 equal bytes repeat inside their document
    assert len(rows) == len(AWKWARD) + 2 and all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (5, 8, 9))
    assert suffix_dedup.cut_out(none, suffix_dedup.repeats(none)).count() == 0


# --- vectors -----------------------------------------------------------------------------------------------------------------


def vectors(spark, seed=1, n=120):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(8, 16))[rng.integers(0, 8, n)] + rng.normal(size=(n, 16)) * rng.choice([0.01, 0.2], (n, 1))
    rows = [(i, x[i].tolist()) for i in range(n)] + [(n, None), (n + 1, [0.0] * 16), (n + 2, [1.0] * 15 + [None]), (n + 3, [float("nan")] * 16), (n + 4, [1.0]), (n + 5, [float("inf")] * 16), (n + 6, x[3].tolist()), (n + 7, (x[3] * 2).tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("tiles", [(4096, 16_384), (3, 17)])
def test_neighbours_equal_brute_force(spark, tiles):
    df = vectors(spark)
    rows, d = neighbours.usable(df, "vec_id", "embedding")
    got: dict[int, list] = {}
    for r in neighbours.nearest(rows.where("id % 20 = 0"), rows, d, 20, *tiles).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    held = {r.id: np.array(r.x) for r in rows.collect()}
    assert len(held) == 122
    for q in (i for i in held if i % 20 == 0):
        score = {i: neighbours.dots(held[q][None], v[None])[0] for i, v in held.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert got[q] == [(k + 1, i, score[i]) for k, i in enumerate(want)]


def test_few_vectors(spark):
    df = vectors(spark, n=4).where("vec_id < 3")
    rows, d = neighbours.usable(df, "vec_id", "embedding")
    assert neighbours.nearest(rows.where("id % 20 = 0"), rows, d).count() == 2
    empty, d = neighbours.usable(df.where("vec_id > 9"), "vec_id", "embedding")
    assert neighbours.nearest(empty, empty, d).count() == 0 and embedding_dedup.dedup(df.where("vec_id > 9")).count() == 0


@pytest.mark.parametrize("size", [8192, 20])
def test_embedding_links_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(embedding_dedup.links, "__defaults__", (*embedding_dedup.links.__defaults__[:-1], size))
    df = vectors(spark, 2)
    df = df.union(df.where("vec_id in (5, 120)"))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df).collect())
    rows = sorted((r.vec_id, r.embedding) for r in df.collect() if r.embedding and len(r.embedding) == 16 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    forest = embedding_dedup._Forest(len(x))
    for i, j in zip(*np.nonzero(link), strict=True):
        forest.join(int(i), int(j))
    ids = [i for i, _ in rows]
    want = [(ids[i], int(link[i].sum()), ids[forest.root(i)], ids[i] == ids[forest.root(i)]) for i in range(len(ids))]
    alone = [(r.vec_id, 0, r.vec_id, True) for r in df.collect() if r.vec_id not in set(ids)]
    assert got == sorted(want + alone)


# --- personal data ---------------------------------------------------------------------------------------------------------------


def test_disclosing_terms(spark):
    texts = [f"our client Zebulon wrote from zeb@mail.example on day {i} and spoke" for i in range(3)] + [f"our client wrote about day {i} and spoke of weather" for i in range(30)] + [None, ""]
    df = docs(spark, texts)
    rows = pii.spans(df).collect()
    by = {r.doc_id: r for r in rows}
    terms = lambda i: {texts[i - 1][t.s : t.e] for t in by[i].terms}
    assert terms(1) == terms(2) == terms(3) == {"Zebulon", "from"} and not any(r.terms for i, r in by.items() if i is None or i > 3)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zebulon" not in clean[1] and "[EMAIL]" in clean[1] and clean[10] == texts[9] and clean[34] is None
    assert pii.sanitise(df).columns == df.columns


def test_telling_terms_far_from_the_entity_and_without_it(spark):
    far = "Zebulon said this " + "our client wrote about weather and spoke " * 20
    texts = [f"{far} zeb@mail.example and ZEBULON" for _ in range(9)] + [f"{far[8:]} we met zebulon here"] + ["our client said this and wrote about weather and spoke and we met here"] * 90
    by = {r.doc_id: r for r in pii.spans(docs(spark, texts)).collect()}
    found = lambda i: [texts[i - 1][t.s : t.e] for t in by[i].terms]
    assert all(found(i) == ["Zebulon", "ZEBULON"] for i in range(1, 10)) and found(10) == ["zebulon"]
    assert not any(found(i) for i in range(11, 101))


def test_telling_terms_equal_plain_counts(spark):
    rng = random.Random(5)
    words = [f"wort{chr(97 + i)}" for i in range(26)] + ["élan", "𝄞𝄞", "abc"]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.8 else f"p{rng.randrange(5)}@ex.org" for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    rows = [(pii.base_spans(t), t) for t in texts]
    apart = [[(m.start(), m.end(), m.group().lower()) for m in pii._TERM.finditer(t) if len(m.group().encode()) >= 4 and not any(m.start() < e and s < m.end() for _, s, e in b)] for b, t in rows]
    own = [{t[s:e].lower() for _, s, e in b} for b, t in rows]
    anywhere = [{m.group().lower() for m in pii._TERM.finditer(t)} for t in texts]
    n, telling = len(texts) + 1, {}
    for e in set().union(*own):
        n_e = sum(e in o for o in own)
        for t in {w for a in apart for *_, w in a}:
            n_te, n_t = sum(e in o and any(w == t for *_, w in a) for o, a in zip(own, apart, strict=True)), sum(t in a for a in anywhere)
            if n_te >= 2:
                telling[t] = max(telling.get(t, 0), np.log(n_te / n_t * n / n_e) / np.log(n / n_e))
    want = {i + 1: [(s, e, telling[w] >= 0.6) for s, e, w in a if telling.get(w, 0) >= 0.4] for i, a in enumerate(apart)}
    got = {r.doc_id: [tuple(t) for t in r.terms] for r in pii.spans(docs(spark, texts), generalise=0.4, remove=0.6).collect() if r.doc_id}
    assert got == want and any(want.values())


def test_term_counts(spark):
    df = docs(spark, ["Alpha beta alpha", "ALPHA gammas", "betas", None, "alpha2beta"])
    names = ["alpha", "beta", "gammas", "none"]
    wanted = spark.createDataFrame([(int(h),) for h in pii.term_hash(names)], "term long")
    got = {r.term: r.n for r in pii.term_counts(df, wanted).join(wanted, "term").collect()}
    assert [got.get(int(h), 0) for h in pii.term_hash(names)] == [3, 2, 1, 0]


def test_pii_query(spark):
    docs_ = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = pii.query(spark, DATA).collect()
    assert len(rows) == len(docs_)
    for r in rows:
        base = pii.base_spans(docs_[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == pii.base_digest(base)
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]


def test_pii_awkward(spark, awkward, none):
    assert pii.spans(awkward).count() == len(AWKWARD) + 2 and pii.spans(none).count() == 0 and pii.sanitise(none).count() == 0


# --- token files --------------------------------------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, awkward, none, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    token_files.write(awkward, str(tmp_path / "t"), tokenizer(), segment=50)
    rows = token_files.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    at, want = 0, sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in awkward.collect()), key=lambda x: x[0])
    for r, (doc, text) in zip(rows, want, strict=True):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids) == (doc, at, len(ids), ids)
        at += len(ids)
    digests = {r.start: r.ids_crc32 for r in token_files.digests(spark, str(tmp_path / "t")).collect()}
    assert digests == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    token_files.write(none, str(tmp_path / "n"), tokenizer())
    assert token_files.read(spark, str(tmp_path / "n")).count() == 0


def test_remembered_chunks_change_nothing():
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(tokenizer()), token_files.Encoder(tokenizer(), remembered=3)
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "é", " ", "\n", "\t", " ", "'s", "12", "!", "<|endoftext|>", "漢", "　", "𝄞", "\x1f", "́"]) for _ in range(rng.randrange(25)))
        (_, raw, off), = common.text_parts(pa.array([text]))
        assert encoder.encode(raw, off)[0].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


# --- queries and pipeline ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(corpus.SQL))
def test_equals_sql(spark, name):
    assert_same(corpus.QUERIES[name](spark, DATA), connect(DATA), corpus.SQL[name])


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    start = spark.read.parquet(f"{DATA}/documents.parquet")
    df = start
    for name, stage in corpus_pipeline.STAGES[:3]:
        df = keep(stage(spark, df, DATA))
        assert df.columns == start.columns, name
    kept = {r.doc_id: r.text for r in df.collect()}
    # plain forms of what these stages have to do
    lang = {r.doc_id for r in language_id.query(spark, DATA).where("not rejected").collect()}
    texts = sorted((r.doc_id, r.text) for r in start.collect() if r.doc_id in lang)
    lines = {i: t for i, t in lines_of(texts, line_dedup.MIN_WORDS).items() if t.split()}
    ids = sorted(lines)
    root = plain_classes([lines[i] for i in ids])
    assert kept == {ids[i]: lines[ids[i]] for i in range(len(ids)) if root[i] == i}
    mixed = keep(mixing.stage(spark, df, DATA))
    copies = {r.doc_id: r.copies for r in mixing.mix(df, spark.read.parquet(f"{DATA}/labels.parquet"))[0].collect()}
    assert mixed.columns == start.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    packed = packing.stage(spark, mixed, DATA).collect()
    check_packing(packed, packing.BUDGET)
    assert len(packed) == mixed.count() == len(corpus_pipeline.run(spark, DATA).collect())
