"""Removal of byte strings of ``LENGTH`` bytes that start more than once in the corpus.

A collection Burrows-Wheeler transform built column by column needs as many rounds as its longest string has
bytes, and each round passes over all that was inserted before. Whole documents as strings would mean a round for each byte of the
longest document over the whole corpus. So the corpus is first cut into many small collections of short
strings, which is exact:

* The minimiser of a window of LENGTH bytes is its ``GRAM``-byte gram with the smallest hash, the leftmost of equal ones.
  Neighbouring windows with the same minimiser form one string, of less than 2 * LENGTH bytes. Equal windows have equal minimisers
  at equal offsets, so two equal windows are always in the collection of the same minimiser.
* Minimisers that occur once are dropped. Equal strings of a collection become one with a count; at a count over one all its windows repeat.
  Only collections with different strings need their bytes, one copy of each.
* Strings of a collection are aligned at their minimiser, so equal windows start in the same column. Columns are inserted from the right,
  one symbol of each string a round: the symbols in the order of the suffixes behind them are the transform of that column, a stable sort by
  symbol gives the next order, and common prefixes follow from the least common prefix between the two predecessors, plus one. A window repeats if its suffix
  shares LENGTH bytes with a neighbour in the order. The columns of a batch of collections lie in one temporary file,
  written once and read once in order; order and common prefixes are kept for one column.
* A collection of more than ``MOST`` different strings is cut further and goes through the same construction. Its windows begin up to LENGTH - GRAM columns before the
  minimiser; those of one half of these places have more columns in common than the whole, and so have equal windows. Each string gives a piece for either half, and pieces
  with equal bytes in the common columns are a collection of their own. Halving ends, after nine rounds at most, with one window to a piece.
* A string that stands in one text several times (low entropy, periods) is one row with the merged places it covers.

Defined results: null counts as empty; texts shorter than LENGTH keep all; matches never cross documents; a row repeated under the same doc_id
is a copy like any other; strings are judged on the input.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import keep, lists, mix64, same_row, signed, table, text_hash, text_parts

LENGTH, GRAM, MOST, BATCH = 400, 100, 50_000, 16_384
_PIECE, _POS = 1 << 20, 22
_P = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i up to n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 21) + 1
        both = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers = both[0], both[1]
    return _powers


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on; of content alone."""
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, from minima up to and from the ends of blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def minimiser_strings(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of rows laid end to end: row, start in the row, bytes, offset of the minimiser, hash of it, of each string."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(raw) < length:
        return none
    if len(raw) > 2 * _PIECE:  # a long row, or the rows beside it: cut, with windows in one piece only
        parts = []
        for row in range(len(off) - 1):
            lo, hi = int(off[row]), int(off[row + 1])
            for a in range(lo, max(lo, hi - length) + 1, _PIECE):
                got = minimiser_strings(raw[a : min(hi, a + _PIECE + length - 1)], np.array([0, min(hi, a + _PIECE + length - 1) - a]), length, gram)
                parts.append((got[0] + row, got[1] + (a - lo), *got[2:]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
    h = gram_hashes(raw, gram)
    low = np.uint64((1 << _POS) - 1)
    key = _window_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    place = (key & low).astype(np.int64)
    ok = np.zeros(len(place), bool)
    row_of = np.zeros(len(place), np.int64)
    for row in np.flatnonzero(np.diff(off) >= length):
        ok[off[row] : off[row + 1] - length + 1] = True
        row_of[off[row] : off[row + 1] - length + 1] = row
    at = np.flatnonzero(ok)
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (row_of[at[1:]] != row_of[at[:-1]])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    row = row_of[first]
    return row, first - off[row], last - first + length, place[first] - first, h[place[first]]


def _gathered(row: np.ndarray, sid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray] | None]]:
    """One place for equal strings of a row: which to keep, how often it stands there, and what its copies cover if there are some."""
    order = np.lexsort((start, sid[:, 1], sid[:, 0], row))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (row[a] != row[b]) | (sid[a] != sid[b]).any(1)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    cover: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(first)
    for i in np.flatnonzero(times > 1):
        mine = order[first[i] : first[i] + times[i]]
        cover[i] = _merge(start[mine], start[mine] + n[mine])
    return order[first], times, cover


def members(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, th, h (minimiser), s1 and s2 (128-bit hash of the string), start, n (bytes), o (offset) of each different string of a row.

    ``times`` tells how often it stands in the row; if more than once, froms and tos are the merged spans of its copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, raw, off in text_parts(b.column(2)):
                row, start, n, o, h = minimiser_strings(raw, off, length, gram)
                if not len(row):
                    continue
                data, begin = raw.tobytes(), off[row] + start
                sid = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s : s + k]) for s, k in zip(begin.tolist(), n.tolist(), strict=True)), "<i8").reshape(-1, 2)
                one, times, cover = _gathered(row, sid, start, n)
                take = pa.array(row[one] + lo)
                spans = [pa.array([None if c is None else c[side] for c in cover], pa.list_(pa.int64())) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(signed(h[one])), pa.array(sid[one, 0]), pa.array(sid[one, 1]), pa.array(start[one]), pa.array(n[one].astype(np.int32)), pa.array(o[one].astype(np.int32)), pa.array(times), *spans],
                    ["doc_id", "th", "h", "s1", "s2", "start", "n", "o", "times", "froms", "tos"],
                )

    return docs.select("doc_id", text_hash().alias("th"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, th long, h long, s1 long, s2 long, start long, n int, o int, times long, froms array<long>, tos array<long>"
    )


def repeated_windows(strings: list[bytes], offset: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes another string of its group holds in the same column.

    ``offset`` is each string's minimiser, column 0; ``group`` rises.
    """
    size = np.array([len(s) for s in strings])
    begin, end = -offset, size - offset
    left, right = int(begin.min()), int(end.max())
    windows = size - length + 1
    flags = np.zeros((len(strings), int(windows.max())), bool)
    width = right - left
    with tempfile.TemporaryFile() as file:
        columns = np.memmap(file, np.uint8, "w+", shape=(width, len(strings)))
        for lo in range(0, len(strings), 1024):
            part = np.zeros((min(1024, len(strings) - lo), width), np.uint8)
            for i, s in enumerate(strings[lo : lo + 1024]):
                part[i, begin[lo + i] - left : end[lo + i] - left] = np.frombuffer(s, np.uint8)
            columns[:, lo : lo + len(part)] = part.T
        order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
        ends = np.argsort(-end, kind="stable")
        nth = 0
        for c in range(right - 1, left - 1, -1):
            symbols = np.asarray(columns[c - left])
            if len(order):  # strings that begin further right leave; their neighbours share the least of what was between
                stay = np.flatnonzero(begin[order] <= c)
                if len(stay) < len(order):
                    common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1])) if len(stay) else common[:0]
                    order = order[stay]
            upto = nth
            while upto < len(ends) and end[ends[upto]] == c + 1:
                upto += 1
            if upto > nth:  # strings that end here come before all of their group
                fresh = np.sort(ends[nth:upto])
                nth = upto
                both = np.concatenate([fresh, order])
                share = np.concatenate([np.zeros(len(fresh), np.int32), common])
                young = np.zeros(len(both), bool)
                young[: len(fresh)] = True
                where = np.argsort(group[both] * 2 + ~young, kind="stable")
                order, common, young = both[where], share[where], young[where]
                common[1:][young[:-1]] = 0
            if not len(order):
                continue
            bwt = symbols[order]
            key = group[order] * 256 + bwt
            rank = np.argsort(key, kind="stable")
            key = key[rank]
            shared = np.zeros(len(rank), np.int32)
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            if len(same):
                a, b = rank[same - 1] + 1, rank[same] + 1
                least = common[a]
                far = np.flatnonzero(b > a + 1)
                if len(far):
                    pairs = np.stack([a[far], b[far]], 1).reshape(-1)
                    least[far] = np.minimum.reduceat(np.append(common, np.int32(0)), pairs)[::2]
                shared[same] = least + 1
            order, common = order[rank], shared
            hit = common >= length
            hit[:-1] |= hit[1:].copy()
            if hit.any():
                who = order[hit]
                flags[who, c - begin[who]] = True
        del columns
    return [flags[i, : windows[i]] for i in range(len(strings))]


def _runs(flag: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of set flags."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1)


_RUNS = "h long, s1 long, s2 long, first array<int>, last array<int>"


def _compare(strings: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows of the strings (h, s1, s2, o, text) of small collections."""

    def emit(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        h = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        found = [_runs(f) for f in repeated_windows([r[4] for r in rows], np.array([r[3] for r in rows], np.int64), group, length)]
        some = [i for i, f in enumerate(found) if len(f)]
        sizes = np.array([len(found[i]) for i in some], np.int64)
        flat = np.concatenate([found[i] for i in some]) if some else np.zeros((0, 2), np.int64)
        ids = [pa.array([rows[i][k] for i in some], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*ids, lists(flat[:, 0].astype(np.int32), sizes, pa.int32()), lists(flat[:, 1].astype(np.int32), sizes, pa.int32())], ["h", "s1", "s2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if len(held) >= BATCH and held[-1][0] != row[0]:
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return strings.repartition("h").sortWithinPartitions("h", "s1", "s2").mapInArrow(run, _RUNS)


_PIECES = "h long, s1 long, s2 long, base int, lo int, hi int, key long, p1 long, p2 long, o int, text binary"


def halves(text: bytes, o: int, lo: int, hi: int, key: int, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first byte, least and greatest place, key, bytes) of the pieces of a string whose windows begin lo to hi columns before column 0, which is at ``o``.

    Windows of one half share the columns [-least place, length - greatest place); the key stands for them.
    """
    mid = (lo + hi) // 2
    for a, b in ((lo, mid), (mid + 1, hi)):
        first, last = max(0, o - b), min(len(text) - length, o - a)
        if a <= b and first <= last:
            shared = text[o - a : o - b + length]
            yield first, a, b, xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True) + a.to_bytes(4, "little") + shared), text[first : last + length]


def _cut_further(pieces: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                out: list[tuple] = []
                for h, s1, s2, base, lo, hi, key, o, text in zip(*(c.to_pylist() for c in b.slice(at, 4096).columns), strict=True):
                    for first, least, most, k, piece in halves(text, o, lo, hi, key, length):
                        p1, p2 = np.frombuffer(xxhash.xxh3_128_digest((o - first).to_bytes(4, "little") + piece), "<i8").tolist()
                        out.append((h, s1, s2, base + first, least, most, k - (1 << 64) if k >> 63 else k, p1, p2, o - first, piece))
                if out:
                    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.int32(), pa.binary()]
                    names = ["h", "s1", "s2", "base", "lo", "hi", "key", "p1", "p2", "o", "text"]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return pieces.select("h", "s1", "s2", "base", "lo", "hi", "key", "o", "text").mapInArrow(run, _PIECES)


def _compare_large(strings: DataFrame, length: int, gram: int, most: int) -> DataFrame | None:
    """The same for large collections, in pieces; None if there are none. Equal pieces become one with a count, by their bytes."""
    origin = ["h", "s1", "s2", "base", "lo", "hi"]
    left = strings.select("h", "s1", "s2", F.lit(0).alias("base"), F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"), F.col("h").alias("key"), "o", "text")
    found = []
    while not left.isEmpty():
        cut = keep(_cut_further(left, length))
        distinct = keep(cut.groupBy("key", "p1", "p2", "o", "text").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*origin)).alias("at")))
        sizes = keep(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("open")).where("size > 1 and open > 0"))
        some = keep(distinct.join(sizes, "key").select("key", "p1", "p2", "o", "text", "at", "size"))
        # a piece of one window is alone in its collection, but for keys that collide
        last = (F.col("size") <= most) | (F.col("at.lo") == F.col("at.hi"))
        small = _compare(some.where(last).select(F.col("key").alias("h"), F.col("p1").alias("s1"), F.col("p2").alias("s2"), "o", "text"), length)
        whole = distinct.where("c > 1").select("key", "p1", "p2", F.array(F.lit(0)).alias("first"), F.array((F.octet_length("text") - length).cast("int")).alias("last"))
        runs = whole.union(small)
        hit = cut.drop("text").join(runs, ["key", "p1", "p2"])
        found.append(keep(hit.select("h", "s1", "s2", *(F.transform(c, lambda x: x + F.col("base")).alias(c) for c in ("first", "last")))))
        left = some.where(~last).select(*(f"at.{c}" for c in origin), "key", "o", "text")
    return functools.reduce(DataFrame.union, found) if found else None


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, th, starts, ends: sorted byte spans (they may overlap) covered by repeated strings, of the rows that have any."""
    every = keep(members(docs, length, gram))
    # kept, so that the joins after it are of plain exchanges, whose hot keys Spark can split
    again = keep(every.groupBy("h").agg(F.sum("times").alias("c")).where("c > 1").select("h"))
    some = keep(every.join(again, "h", "left_semi"))
    place = F.struct("doc_id", "th", "start")
    distinct = keep(some.groupBy("h", "s1", "s2", "n", "o").agg(F.sum("times").alias("c"), F.min(place).alias("at")))
    whole = distinct.where("c > 1").select("h", "s1", "s2", F.array(F.lit(0)).alias("first"), F.array(F.col("n") - length).alias("last"))
    sizes = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("open")).where("size > 1 and open > 0")
    needed = distinct.join(keep(sizes.select("h", "size")), "h")
    by_doc = needed.groupBy(F.col("at.doc_id").alias("__id"), F.col("at.th").alias("__th")).agg(F.collect_list(F.struct("h", "s1", "s2", "o", "size", (F.col("at.start") + 1).cast("int").alias("from"), "n")).alias("cuts"))
    rows = docs.select("doc_id", text_hash().alias("th"), F.col("text").cast("binary").alias("text"))
    cut = rows.join(by_doc, same_row(rows, by_doc, "doc_id", "th", "__id", "__th"))
    # a repeated row would give its strings twice; one of them is enough
    strings = keep(cut.dropDuplicates(["__id", "__th"]).select("text", F.explode("cuts").alias("x")).select("x.h", "x.s1", "x.s2", "x.o", F.substring("text", F.col("x.from"), F.col("x.n")).alias("text"), "x.size"))
    runs = whole.union(_compare(strings.where(F.col("size") <= most).drop("size"), length))
    large = _compare_large(strings.where(F.col("size") > most).drop("size"), length, gram, most)
    if large is not None:
        runs = runs.union(large)
    # copies inside one text repeat as a whole: what they cover is known already
    froms = F.when(F.col("froms").isNull(), F.transform("first", lambda x: F.col("start") + x)).otherwise(F.col("froms"))
    tos = F.when(F.col("tos").isNull(), F.transform("last", lambda x: F.col("start") + x + length)).otherwise(F.col("tos"))
    hit = some.join(runs, ["h", "s1", "s2"]).select("doc_id", "th", F.explode(F.arrays_zip(froms.alias("a"), tos.alias("b"))).alias("s"))
    spans = hit.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("s")).alias("s"))
    return spans.select("doc_id", "th", F.col("s.a").alias("starts"), F.col("s.b").alias("ends"))


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans sorted by start; spans that touch are one run."""
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], np.append(reach[:-1][new[1:]], reach[-1:])


def cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """struct r of each row with n_bytes, n_removed, n_spans, kept (binary, what is left) and kept_sha256."""
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "starts", "ends")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), docs["doc_id"].alias("__d"), text_hash("text").alias("__h"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("__b"))

    @F.arrow_udf("struct<n_removed:long,n_spans:long,kept:binary,sha:string>")
    def cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out: tuple[list[int], list[int], list[bytes], list[str]] = ([], [], [], [])
        for t, s, e in zip(text, starts, ends, strict=True):
            data = t.as_buffer()
            if not s.is_valid:
                kept, gone, n = bytes(data), 0, 0
            else:
                a, b = _merge(s.values.to_numpy(), e.values.to_numpy())
                edges = [0, *np.stack([a, b], 1).reshape(-1).tolist(), len(data)]
                view = memoryview(data)
                kept, gone, n = b"".join(view[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)), int((b - a).sum()), len(a)
            for x, y in zip(out, (gone, n, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                x.append(y)
        return pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())], ["n_removed", "n_spans", "kept", "sha"])

    joined = rows.join(spans, same_row(rows, spans, "__d", "__h", "__id", "__th"), "left")
    made = joined.select("r", F.octet_length("__b").cast("long").alias("n_bytes"), cut.asNondeterministic()("__b", "starts", "ends").alias("c"))
    return made.select("r", "n_bytes", F.col("c.n_removed").alias("n_removed"), F.col("c.n_spans").alias("n_spans"), F.col("c.kept").alias("kept"), F.col("c.sha").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cut_out(docs, repeats(docs)).select("r.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
