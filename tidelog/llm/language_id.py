"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text is lower-cased, everything but letters separates words, and the letter n-grams (one to three,
with a mark at both word ends) are hashed into a fixed number of dimensions, weighted by
``log(1 + tf) * idf`` and scaled to length one. Each language owns several centroids, the result of
spherical k-means over its training vectors. A text gets the language of the centroid with the
largest cosine. It is rejected when that cosine is less than ``share`` of what the middle training text of that language and of
about the same length has. Text in no learnt language and text of one word again and again lie below, prose far above.

Fitting uses a bounded sample, ``sample_per_lang`` texts of each language; predicting is a map over
whole texts without a shuffle. What the driver holds is languages x centroids x dimensions.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without
any training row every text is ``und``; equal cosines go to the language that sorts first; texts of any length are read whole; of rows with one doc_id and
several texts any may be learnt from, the same ones each time; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_sample, keep, table

DIMS = 1 << 13
_PIECE = 1 << 19
_BINS = 24
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _rows(texts: list[str]) -> list[tuple[int, str]]:
    """(row, piece): long texts are cut behind a letter-free place, where no n-gram passes."""
    out = []
    for row, text in enumerate(texts):
        at = 0
        while len(text) - at > _PIECE:
            end = at + _PIECE
            while end < len(text) and text[end].isalpha():
                end += 1
            out.append((row, text[at:end]))
            at = end
        out.append((row, text[at:]))
    return out


def _count(rows: list[tuple[int, str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts, a row of DIMS for each text, and the number of letters of each text."""
    counts, letters = np.zeros((n, DIMS), np.float32), np.zeros(n, np.int64)
    if not rows:
        return counts, letters
    codes = np.frombuffer("".join(f" {p} " for _, p in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.array([r for r, _ in rows], np.int64), [len(p) + 2 for _, p in rows])
    letter = _is_letter()[codes]
    held = letter.copy()
    held[1:] |= letter[:-1]  # of what lies between words one mark stays
    held[0] = True
    c, owner, letter = np.where(letter[held], codes[held], 32).astype(np.uint64), owner[held], letter[held]
    letters += np.bincount(owner[letter], minlength=n)
    mul = np.uint64(0x9E3779B97F4A7C15)
    top = np.uint64(64 - 13)
    one = (c * mul + np.uint64(1)) * mul
    two = ((c[:-1] * mul + c[1:]) * mul + np.uint64(2)) * mul
    three = (((c[:-2] * mul + c[1:-1]) * mul + c[2:]) * mul + np.uint64(3)) * mul
    same2, same3 = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    for gram, at, ok in (
        (one, owner, letter),
        (two, owner[1:], same2 & (letter[1:] | letter[:-1])),
        (three, owner[2:], same3 & letter[1:-1]),
    ):
        cell = at[ok] * DIMS + ((gram[ok] ^ (gram[ok] >> np.uint64(29))) * mul >> top).astype(np.int64)
        counts += np.bincount(cell, minlength=n * DIMS).reshape(n, DIMS)
    return counts, letters


def vectors(texts: list[str], idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors of the texts (without idf: the n-gram counts) and their letter counts."""
    counts, letters = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.int64)
    part: list[tuple[int, str]] = []
    size = 0
    for row, piece in [*_rows([t.lower() for t in texts]), (-1, "")]:
        if row < 0 or size + len(piece) > _PIECE and part:
            first, last = part[0][0], part[-1][0]
            x, k = _count([(r - first, p) for r, p in part], last - first + 1)
            counts[first : last + 1] += x
            letters[first : last + 1] += k
            part, size = [], 0
        if row >= 0:
            part.append((row, piece))
            size += len(piece)
    if idf is None:
        return counts, letters
    np.log1p(counts, out=counts)
    counts *= idf
    length = np.sqrt(np.einsum("ij,ij->i", counts, counts))
    counts /= np.maximum(length, 1e-12)[:, None]
    return counts, letters


def _bin(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), _BINS - 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids; starts from the mean's nearest row and then the farthest rows, so it is deterministic."""
    mean = x.mean(0)
    seeds = [int(np.argmax(x @ mean))]
    best = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        # the farthest quarter's middle row: an outlier makes no good seed
        far = np.argsort(best, kind="stable")[: max(1, len(x) // 4)]
        seeds.append(int(far[len(far) // 2]))
        best = np.maximum(best, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    return c


def floors(cos: np.ndarray, bins: np.ndarray, share: float = 0.65, loose: float = 0.5, enough: int = 20) -> np.ndarray:
    """The least cosine of each length that is not rejected: ``share`` of the median training cosine of that length.

    The median stands whatever junk the training texts hold. A length of too few texts takes the floor of the nearest length that has enough; shorter
    texts than all of these, whose cosines spread widely, the least of all training cosines times ``loose``.
    """
    filled = np.flatnonzero(np.bincount(bins, minlength=_BINS) >= enough)
    if not len(filled):
        return np.full(_BINS, loose * cos.min())
    own = np.array([share * np.median(cos[bins == b]) for b in filled])
    out = own[np.abs(np.arange(_BINS)[:, None] - filled).argmin(1)]
    out[: filled[0]] = loose * cos.min()
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        out, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for lo in range(0, len(texts), 128):
            x, letters = vectors(texts[lo : lo + 128], self.idf)
            if not len(self.langs):
                continue
            cos = np.stack([(x @ self.centroids[self.owner == j].T).max(1) for j in range(len(self.langs))], 1)
            best, bins = cos.argmax(1), _bin(letters)
            for i in np.flatnonzero(letters > 0):
                out[lo + i] = self.langs[best[i]]
                score[lo + i] = min(1.0, max(0.0, float(cos[i, best[i]])))
                rejected[lo + i] = cos[i, best[i]] < self.floor[best[i], bins[i]]
        return out, score, rejected


def fit(train: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", sample_per_lang: int = 1200, centroids: int = 4, share: float = 0.65) -> Model:
    """Fits centroids on at most ``sample_per_lang`` texts of each non-null language."""
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("__id"), F.col(lang).alias("__lang"), F.col(text).alias("__text"))
    sample = keep(bounded_sample(rows, "__lang", "__id", sample_per_lang))

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        df = np.zeros(DIMS, np.int64)
        for lo in range(0, len(pdf), 128):
            df += (vectors(list(pdf["__text"][lo : lo + 128]), None)[0] > 0).sum(0)
        return pd.DataFrame({"lang": [pdf["__lang"].iloc[0]], "n": [len(pdf)], "df": [df.astype("<i8").tobytes()]})

    seen = sample.groupBy("__lang").applyInPandas(frequencies, "lang string, n long, df binary").collect()
    if not seen:
        return Model([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, _BINS)))
    total = sum(r.n for r in seen)
    df = np.sum([np.frombuffer(bytes(r.df), "<i8") for r in seen], axis=0)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [vectors(list(pdf["__text"][lo : lo + 128]), idf) for lo in range(0, len(pdf), 128)]
        x, letters = np.concatenate([p[0] for p in parts])[:], np.concatenate([p[1] for p in parts])
        x, letters = x[letters > 0], letters[letters > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "floor": []})
        c = spherical_kmeans(x, centroids)
        cos, bins = (x @ c.T).max(1), _bin(letters)
        low = floors(cos, bins, share)
        return pd.DataFrame({"lang": [pdf["__lang"].iloc[0]], "c": [c.astype("<f4").tobytes()], "floor": [low.astype("<f8").tobytes()]})

    made = sorted(sample.groupBy("__lang").applyInPandas(cluster, "lang string, c binary, floor binary").collect(), key=lambda r: r.lang)
    parts = [np.frombuffer(bytes(r.c), "<f4").reshape(-1, DIMS) for r in made]
    return Model(
        [r.lang for r in made],
        idf,
        np.concatenate(parts) if parts else np.zeros((0, DIMS), np.float32),
        np.repeat(np.arange(len(made)), [len(p) for p in parts]),
        np.stack([np.frombuffer(bytes(r.floor), "<f8") for r in made]) if made else np.zeros((0, _BINS)),
    )


def predict_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang, score, rejected) of a text column, as an Arrow function over whole texts."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def label(col: pa.Array) -> pa.Array:
        lang, score, rejected = held.value.predict(pc.fill_null(col, "").to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["lang", "score", "rejected"])

    return label.asNondeterministic()(text)  # else the optimiser may evaluate it twice


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row (held_out false for a null doc_id)."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), predict_column(docs.sparkSession, model, F.col("text")).alias("__p")).select(
        "doc_id", "held_out", F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score"), F.col("__p.rejected").alias("rejected")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(training_rows(docs)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject."""
    model = fit(training_rows(docs))
    names = docs.columns
    row = docs.select(F.struct(*(docs[c] for c in names)).alias("r"), predict_column(spark, model, docs["text"]).alias("p"))
    return row.where(~F.col("p.rejected")).select("r.*")
