"""Personal data: patterns, and the terms that would give them away.

Base spans come from patterns: email, ip, card and phone. The protected entities are the distinct values that they
hold. Terms are runs of letters (ASCII case folded) of at least ``MIN_BYTES`` bytes that touch no base span. Over the whole corpus three
document counts are taken: of each entity, of each term (anywhere), and of both in one document, wherever they stand in it. The disclosure of
entity e by term t is the pointwise mutual information as a share of the entity's information, log(p(e|t) / p(e)) / -log p(e): 1 if the
term occurs with the entity only, 0 if it says nothing. Terms of at least ``SUPPORT`` common documents are removed from ``REMOVE`` on,
generalised from ``GENERALISE`` on, at every place of the corpus where they stand, also in documents without a base span.

Pairs are ruled out by exact bounds before they are made: common documents are no more than the entity's, and a term is in at least as many
documents as it is found in beside any entity, so one too frequent for every entity of a document is not paired there.

The text is read three times and never shuffled; what is shuffled are the terms of documents that hold an entity of enough documents, a
number for each such term and run of rows, and the places of telling terms: a bitmap of fixed size (8 MB) of the terms is broadcast before.

Defined results: a null text counts as empty; offsets are code points, ends exclusive; matches of one kind do not overlap, of
different kinds they may; a match that fails its kind's test is dropped, and the search goes on behind it; a row repeated under one doc_id has equal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.common import keep, same_row, signed, table, text_hash, text_parts, word_hashes

KINDS = ("email", "ip", "card", "phone")
MIN_BYTES, SUPPORT, GENERALISE, REMOVE = 4, 2, 0.7, 0.9
FILTER, _SUMMED = 1 << 26, 1 << 20

# Possessive forms of the given patterns; where one could start again inside a run of digits, a look-behind keeps the search linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def _card_ok(s: str) -> bool:
    digits = re.sub(r"[ -]", "", s)
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _phone_ok(s: str) -> bool:
    return 8 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for kind, pattern, ok in ((1, _IP, _ip_ok), (2, _CARD, _card_ok), (3, _PHONE, _phone_ok)):
        if kind < 3 or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m.group())]
    return out


def entity(kind: int, value: str) -> int:
    """A hash of the kind and what makes the value the same: letters in one case, digits alone."""
    plain = value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}") - (1 << 63)


def exposed(text: str, spans: list[tuple[int, int, int]], window: int) -> Iterator[tuple[int, int, int, str]]:
    """(index of span, start, end, term): the terms nearest to each base span that touch no base span."""
    taken = sorted((s, e) for _, s, e in spans)
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist()
    for k, (_, s, e) in enumerate(spans):
        for side in (0, 1):
            found: list[tuple[int, int]] = []
            width = 16 * window
            while True:
                lo, hi = (max(0, s - width), s) if side == 0 else (e, min(len(text), e + width))
                found = [(m.start(), m.end()) for m in _TERM.finditer(text, lo, hi) if len(m.group().encode()) >= MIN_BYTES]
                # a term that the cut may have split is read again further out
                edge = found and (found[0][0] == lo > 0 if side == 0 else found[-1][1] == hi < len(text))
                if edge and len(found) > window:
                    found = found[1:] if side == 0 else found[:-1]
                    edge = False
                if (len(found) >= window and not edge) or (lo == 0 if side == 0 else hi == len(text)):
                    break
                width *= 4
            for a, b in found[-window:] if side == 0 else found[:window]:
                i = int(np.searchsorted(starts, b)) - 1
                if i < 0 or reach[i] <= a:
                    yield k, a, b, text[a:b]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_OTHER = np.ones(256, bool)
_OTHER[97:123] = False
_OTHER[128:] = False


def term_hash(terms: list[str]) -> np.ndarray:
    """The hash that the corpus counts use."""
    col = pa.array([t.encode() for t in terms], pa.binary())
    out = []
    for _, raw, off in text_parts(col):
        out.append(word_hashes(_FOLD[raw], off[:-1], off[1:]))
    return signed(np.concatenate(out)) if out else np.zeros(0, np.int64)


def free_terms(text: bytes, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every term of a text that touches no base span."""
    raw = np.frombuffer(text, np.uint8)
    folded = _FOLD[raw]
    starts, stops, _ = common.word_bounds(folded, np.array([0, len(raw)]), _OTHER)
    long = stops - starts >= MIN_BYTES
    starts, stops = starts[long], stops[long]
    point = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=point[1:])
    s, e = point[starts], point[stops]
    taken = sorted((a, b) for _, a, b in spans)
    i = np.searchsorted(np.array([a for a, _ in taken], np.int64), e) - 1
    reach = np.maximum.accumulate(np.array([0, *(b for _, b in taken)], np.int64))
    free = reach[i + 1] <= s
    return signed(word_hashes(folded, starts[free], stops[free])), s[free], e[free]


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, th, base array<struct<k,s,e>>, own (the entities) of every row, and the different terms of those that hold an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(2), "").to_pylist()
            for lo in range(0, len(text), 256):
                part = [base_spans(t) for t in text[lo : lo + 256]]
                base = pa.array([[{"k": k, "s": s, "e": e} for k, s, e in spans] for spans in part], pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])))
                own = pa.array([sorted({entity(k, text[lo + i][s:e]) for k, s, e in spans}) for i, spans in enumerate(part)], pa.list_(pa.int64()))
                terms = pa.array([np.unique(free_terms(text[lo + i].encode(), spans)[0]) if spans else [] for i, spans in enumerate(part)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), b.column(1).slice(lo, len(part)), base, own, terms], ["doc_id", "th", "base", "own", "terms"])

    schema = "doc_id long, th long, base array<struct<k:int,s:int,e:int>>, own array<long>, terms array<long>"
    return docs.select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, schema)


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = (h & np.uint64(FILTER - 1)).astype(np.int64)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, th, term, s, e): where the wanted terms, and a few that share their bits, stand free of base spans, over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(term_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            for lo, raw, off in text_parts(b.column(2)):
                folded = _FOLD[raw]
                starts, stops, row = common.word_bounds(folded, off, _OTHER)
                long = stops - starts >= MIN_BYTES
                some = _in_filter(bits, word_hashes(folded, starts[long], stops[long]))
                rows, out = np.unique(row[long][some]).tolist(), []
                for i in rows:
                    text = raw[off[i] : off[i + 1]].tobytes()
                    h, s, e = free_terms(text, base_spans(text.decode()))
                    ok = _in_filter(bits, h.view(np.uint64))
                    out.append((h[ok], s[ok], e[ok]))
                if out:
                    n = np.repeat(np.array(rows, np.int64) + lo, [len(h) for h, _, _ in out])
                    h, s, e = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(n)), b.column(1).take(pa.array(n)), pa.array(h), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["doc_id", "th", "term", "s", "e"])

    return docs.select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, "doc_id long, th long, term long, s int, e int")


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER`` bits, one for each value of the low bits of the terms' hashes; its size is fixed."""
    bit = F.col("term").bitwiseAND(FILTER - 1) + 1
    made = terms.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((FILTER >> 15, 1 << 12), np.uint8)
    for r in made.collect():
        out[r.b - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n): the number of documents that hold each term, over all documents, for the wanted terms and a few that share their bits.

    The bitmap goes to the executors, so other terms are not shuffled, however many there are.
    """
    held = docs.sparkSession.sparkContext.broadcast(term_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        terms, counts, waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            term, at = np.unique(np.concatenate(terms), return_inverse=True)
            return term, np.bincount(at, weights=np.concatenate(counts), minlength=len(term)).astype(np.int64)

        for b in batches:
            for _, raw, off in text_parts(b.column(0)):
                raw = _FOLD[raw]
                starts, stops, row = common.word_bounds(raw, off, _OTHER)
                long = stops - starts >= MIN_BYTES
                h, row = word_hashes(raw, starts[long], stops[long]), row[long]
                some = _in_filter(bits, h)
                h, row = h[some], row[some]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                term, n = np.unique(h[new], return_counts=True)
                terms.append(term)
                counts.append(n)
                waiting += len(term)
                if waiting > _SUMMED:
                    term, n = summed()
                    terms, counts, waiting = [term], [n], len(term) // 2
        term, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(signed(term)), pa.array(n, pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, th, base and terms (array of struct s, e, removed) of every row."""
    found = keep(_found(docs).withColumn("row", F.monotonically_increasing_id()))
    total = found.count()
    every = F.lit(float(max(total, 1)))
    information = F.log(every / F.col("n_e"))

    def share(n: str) -> Column:
        return F.when(information > 0, F.least(F.lit(1.0), F.log(F.col("n_te") / F.col(n) * every / F.col("n_e")) / information)).otherwise(0.0)

    def within(n_e: str) -> Column:
        """Whether a term of n_held documents can reach the threshold for an entity of n_e, if all of the entity's documents held it."""
        return F.log(every / F.col("n_held")) >= generalise * F.log(every / F.col(n_e)) - 1e-9

    with_own = found.where(F.size("own") > 0)
    one_each = with_own.groupBy("doc_id", "th").agg(F.min("row").alias("row")).select("row")
    # common documents are no more than the entity's
    entities = with_own.select(F.explode("own").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where((F.col("n_e") >= support) & (information > 0))
    # what is aggregated is kept, so that the joins are of plain exchanges, whose hot keys Spark can split
    holders = keep(with_own.select("row", F.explode("own").alias("entity")).join(keep(entities), "entity").join(keep(one_each), "row", "left_semi"))
    most = keep(holders.groupBy("row").agg(F.max("n_e").alias("most")))
    beside = keep(with_own.select("row", "terms").join(most, "row"))
    each = beside.select("row", "most", F.explode("terms").alias("term"))
    # a term is in at least as many documents as it is found in here: what fails by that number needs no pair and no count over the corpus
    held = keep(each.groupBy("term").agg(F.count(F.lit(1)).alias("n_held")).where(F.col("n_held") >= support))
    near = each.join(held, "term").where(within("most")).select("row", "term", "n_held")
    pairs = near.join(holders, "row").where(within("n_e"))
    together = pairs.groupBy("entity", "term", "n_e", "n_held").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    possible = keep(together.where(share("n_held") >= generalise))
    shares = possible.join(term_counts(docs, possible.select("term")), "term").withColumn("share", share("n")).where(F.col("share") >= generalise)
    telling = keep(shares.groupBy("term").agg(F.max("share").alias("share")))
    marked = places(docs, telling).join(telling, "term").select("doc_id", "th", "s", "e", "share").distinct()
    per_row = marked.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.sort_array(F.collect_list(F.struct("s", "e", (F.col("share") >= remove).alias("removed")))).alias("terms"))
    out = found.select("doc_id", "th", "base").join(per_row, same_row(found, per_row, "doc_id", "th", "__id", "__th"), "left")
    empty = F.array().cast("array<struct<s:int,e:int,removed:boolean>>")
    return out.select("doc_id", "th", "base", F.coalesce("terms", empty).alias("terms"))


def _joined(base: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(base, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _only(kind: int) -> Callable[[Column], Column]:
    """A number if it is the kind, else null. (A second parameter of the function would be taken for the position.)"""
    return lambda k: F.when(k == kind, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = _joined(F.col("base"))
    terms = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string"))), ",")
    both = F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms))
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), both.alias("spans"), F.size("terms").cast("long").alias("n_term"))


def redact(text: str, base: list[tuple[int, int, int]], terms: list[tuple[int, int, bool]]) -> str:
    """The text with base spans as [KIND], generalised terms as [TERM], removed terms left out; the first of overlapping spans counts."""
    out, at = [], 0
    marks = [(s, e, f"[{KINDS[k].upper()}]") for k, s, e in base] + [(s, e, "" if gone else "[TERM]") for s, e, gone in terms]
    for s, e, put in sorted(marks):
        if s >= at:
            out += [text[at:s], put]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of docs with their text redacted; null texts stay null."""
    found = spans(docs, **options).dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "base", "terms")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), docs["doc_id"].alias("__d"), docs["text"].alias("__t"), text_hash("text").alias("__h"))

    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, [(x["k"], x["s"], x["e"]) for x in b], [(x["s"], x["e"], x["removed"]) for x in w]) for t, b, w in zip(text, base, terms, strict=True)], dtype=object)

    joined = rows.join(found, same_row(rows, found, "__d", "__h", "__id", "__th"))
    made = joined.select("r", clean.asNondeterministic()("__t", "base", "terms").alias("__clean"))
    return made.select(*(F.col("__clean").alias("text") if c == "text" else F.col("r")[c].alias(c) for c in docs.columns))


def base_digest(base: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
