"""Token ids of documents in compressed binary files, and back.

Documents are range-partitioned and sorted by doc_id. Each partition tokenises its texts, appends the end id to each, and cuts the
stream of ids at document ends into segments of about ``SEGMENT`` ids. A segment is one record of the files: its place (part,
seg), the doc_ids and id counts of its documents, the number of ids and a blob of ``range_coder``, whose blocks start anew and carry
checksums. Records live in Parquet files, so that Spark's commit protocol covers lost executors and any store serves. A segment is
decoded by itself; where its documents start follows from sums of the segments before.

Defined results: a null text has the end id alone; a null doc_id comes first; rows of one doc_id follow by text hash, so repeated rows are written as often
as they occur; a text of any length is one document, in one segment; other columns, whatever their names, are not read; no rows give no records.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import range_coder
from tidelog.llm.common import _M1, _MASK, _SPACE, lists, mix64, shared_dir, table, text_hash, text_parts

END, SEGMENT, REMEMBERED = 2, 1 << 22, 2_000_000
_UPTO = _MASK  # of eight bytes, the first n
# The normaliser and pre-tokenizer of the file as it must be for words to be encoded by themselves (fixed values of the tokenizer's format).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
_PIECE = regex.compile(_SPLIT + r"|\n")
#: Words whose characters every version of Unicode classes and lower-cases alike, and that normalisation leaves as they are.
_PLAIN = regex.compile("[\n!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]*+")
_SIMPLE, _SIMPLE_PIECE = re.compile(r"[\n!-~]*+"), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n")
#: Signs for bytes, as byte-level tokenizers write them: printable Latin-1 as itself, the others from 256 on; the space between words stays.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED))) if b != 32}
_SCHEMA = "part int, seg int, doc_ids array<long>, counts array<long>, n_ids long, blob binary"


class _Words:
    """Numbers of words of at most 15 bytes, found by their bytes in an open table; exact, since a key is the word and its length."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.held = bits, 0
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.zeros(1 << bits, np.int32)

    def room(self, more: int) -> None:
        """Keeps at least half of the table empty."""
        if 2 * (self.held + more) > 1 << self.bits:
            wide, full = _Words((2 * (self.held + more)).bit_length()), np.flatnonzero(self.high)
            while len(full):  # keys that meet in one place: one now, the others in the next round
                at = wide.place(self.low[full], self.high[full])
                _, first = np.unique(at, return_index=True)
                wide.put(at[first], self.low[full[first]], self.high[full[first]], self.value[full[first]])
                full = np.delete(full, first)
            self.__dict__ = wide.__dict__

    def put(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Keys into different empty places."""
        self.low[at], self.high[at], self.value[at] = low, high, value
        self.held += len(at)

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each key its place in the table, or the empty place where it belongs."""
        at = (mix64(low * _M1 ^ high) >> np.uint64(64 - self.bits)).view(np.int64)
        todo = np.flatnonzero((self.low.take(at) != low) | (self.high.take(at) != high))
        while len(todo):
            here = at.take(todo)
            held = self.high.take(here)
            todo = todo[(held != 0) & ((held != high.take(todo)) | (self.low.take(here) != low.take(todo)))]
            at[todo] = at.take(todo) + 1 & (1 << self.bits) - 1
        return at


class Encoder:
    """Whole texts to ids, without special tokens.

    Where the file's steps are the known ones (``_STEPS``), which never join characters across white space, words between ASCII white space are encoded
    once and remembered, at most ``remembered`` of them. New words of plain Latin characters are lower-cased and split here and go to the library's merges
    alone; all others go through the whole library. With any other steps every text is encoded by the library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = [spec["normalizer"], spec["pre_tokenizer"]] == _STEPS and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>"
        if self.by_words:
            self.marks = tuple(t["content"] for t in spec["added_tokens"])
            self.line = spec["model"]["vocab"][_BYTE_SIGNS[10] + "</w>"]
            spec |= {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": [], "post_processor": None}
            self.merges = Tokenizer.from_str(json.dumps(spec))
            self.forget()

    def forget(self) -> None:
        self.words, self.long = _Words(), {}
        self.start, self.size, self.held = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.ids, self.used = np.zeros(8192, np.int32), 0

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of rows of UTF-8 bytes laid end to end, and the number of ids of each row."""
        if not self.by_words:
            made = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(made), np.int32), np.array([len(x) for x in made], np.int64)
        if self.held > self.remembered:
            self.forget()
        starts, stops = _bounds(raw, off)
        which = self.find(raw, starts, stops)
        size = self.size.take(which)
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0)
        at += np.repeat(self.start.take(which) - (upto - size), size)
        before = np.concatenate([[0], upto])
        return self.ids.take(at), np.diff(before[np.searchsorted(starts, off)])

    def find(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The remembered number of each word; new words are encoded."""
        size = stops - starts
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))  # the eight bytes from each place on
        low = eight[starts] & _UPTO.take(np.minimum(size, 8))
        high = eight[starts + 8] & _UPTO.take(np.clip(size - 8, 0, 7))
        high |= size.astype(np.uint64) << np.uint64(56)
        far = np.flatnonzero(size > 15)
        high[far] = 1 << 56  # a key of no word with this low: place it nowhere, it is found by its text below
        low[far] = 0
        at = self.words.place(low, high)
        new = np.flatnonzero((self.words.high.take(at) == 0) & (size <= 15))
        if len(new):
            bits = self.words.bits
            self.words.room(len(np.unique(mix64(low.take(new) * _M1 ^ high.take(new)))) + 64)
            if bits != self.words.bits:
                at = self.words.place(low, high)
        while len(new):
            _, first = np.unique(at.take(new), return_index=True)
            some = new[first]
            self.words.put(at.take(some), low.take(some), high.take(some), self.add([raw[a:b].tobytes() for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True)]))
            at[new] = self.words.place(low.take(new), high.take(new))
            new = new[self.words.high.take(at.take(new)) == 0]
        which = self.words.value.take(at).astype(np.int64)
        if len(far):
            texts = [raw[a:b].tobytes() for a, b in zip(starts[far].tolist(), stops[far].tolist(), strict=True)]
            unknown = [t for t in dict.fromkeys(texts) if t not in self.long]
            self.long.update(zip(unknown, self.add(unknown).tolist(), strict=True))
            which[far] = [self.long[t] for t in texts]
        return which

    def add(self, words: list[bytes]) -> np.ndarray:
        """Encodes new words; their numbers."""
        flat, start, size = self.fresh([w.decode() for w in words])
        n, k = self.held + len(words), self.used + len(flat)
        if n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.start, self.size))
        if k > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(k, np.int32)])
        self.ids[self.used : k] = flat
        self.size[self.held : n] = size
        self.start[self.held : n] = self.used + start
        made = np.arange(self.held, n, dtype=np.int32)
        self.held, self.used = n, k
        return made

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of the words laid end to end in some order, and where each word's begin and how many they are."""
        plain, hard = [], []
        ascii_ = [w.isascii() for w in words]
        for kind, simple in ((True, _SIMPLE), (False, _PLAIN)):
            group = [i for i, a in enumerate(ascii_) if a is kind]
            joined = "\n".join([words[i] for i in group])
            if not simple.fullmatch(joined) or any(m in joined for m in self.marks):
                odd = [i for i in group if "\n" in words[i] or not simple.fullmatch(words[i]) or any(m in words[i] for m in self.marks)]
                hard += odd
                group = sorted(set(group) - set(odd))
            if group:
                plain.append((group, kind))
        flat, start, size, at = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for group, kind in plain:
            joined = "\n".join([words[i] for i in group]).lower() + "\n"
            joined = " ".join((_SIMPLE_PIECE if kind else _PIECE).findall(joined))
            joined = joined.replace("\n", _BYTE_SIGNS[10]) if kind else joined.encode().decode("latin-1").translate(_BYTE_SIGNS)
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            close = np.flatnonzero(ids == self.line)  # the line's end behind each word
            if len(close) != len(group):
                raise ValueError("the merges do not keep lines apart")
            begin = np.concatenate([[0], close[:-1] + 1])
            start[group], size[group] = at + begin, close - begin
            flat.append(ids)
            at += len(ids)
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([words[i] for i in hard], add_special_tokens=False) if hard else [], strict=True):
            start[i], size[i] = at, len(e.ids)
            flat.append(np.array(e.ids, np.int32))
            at += len(e.ids)
        return np.concatenate(flat), start, size


def _bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in order."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.zeros(len(raw) + 1, bool)
    np.logical_not(_SPACE.take(raw), out=word[:-1])
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = word[0]
    np.not_equal(word[1:], word[:-1], out=edge[1:])
    cut = off[1:-1]  # words that touch across rows
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))])
    cut = cut[word[cut] & word[cut - 1]]
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    return at[::2], at[1::2]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its table serves all tasks."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, segment: int = SEGMENT) -> None:
    """Writes the files of docs (doc_id, text) to a new folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seg = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs_: list[pa.Array] = []

        def record() -> pa.RecordBatch:
            n, blob = np.concatenate(sizes), range_coder.encode(np.concatenate(ids))
            place = [pa.array([x], pa.int32()) for x in (part, seg)]
            names = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(docs_))
            return pa.RecordBatch.from_arrays([*place, names, lists(n, np.array([len(n)]), pa.int64()), pa.array([int(n.sum())]), pa.array([blob], pa.binary())], ["part", "seg", "doc_ids", "counts", "n_ids", "blob"])

        held = 0
        for b in batches:
            for lo, raw, off in text_parts(b.column(1), most=1 << 20):
                x, n = coder.encode(raw, off)
                ids.append(np.insert(x, np.cumsum(n), end))
                sizes.append(n + 1)
                docs_.append(b.column(0).slice(lo, len(n)))
                held += len(ids[-1])
                if held >= segment:
                    yield record()
                    ids, sizes, docs_, held, seg = [], [], [], 0, seg + 1
        if ids:
            yield record()

    rows = docs.select("doc_id", "text", text_hash().alias("th")).repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    rows.select("doc_id", "text").mapInArrow(run, _SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of each document of the files; raises where a block is damaged."""
    return _read(spark, path, True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files."""
    return _read(spark, path, False)


def _read(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    rows = spark.read.schema(_SCHEMA).parquet(path)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before(Window.orderBy("part")).alias("part_start"))
    segs = rows.select("part", "seg", F.col("n_ids").alias("n")).withColumn("seg_start", before(Window.partitionBy("part").orderBy("seg")))
    place = segs.join(parts, "part").select("part", "seg", (F.col("seg_start") + F.col("part_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, counts = b.column(2)[i].values, b.column(3)[i].values.to_numpy()
                ids = range_coder.decode(b.column(4)[i].as_buffer().to_pybytes()).astype("<u4")
                if len(ids) != counts.sum():
                    raise ValueError("the number of ids does not fit the document index")
                edge = np.concatenate([[0], np.cumsum(counts)])
                view = memoryview(ids).cast("B")
                last = lists(ids.astype(np.int32), counts, pa.int32()) if whole else pa.array([zlib.crc32(view[x:y]) for x, y in pairwise((4 * edge).tolist())], pa.int64())
                own = [pa.array(np.full(len(counts), b.column(k)[i].as_py(), np.int32)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, docs, pa.array(edge[:-1], pa.int64()), pa.array(counts, pa.int64()), last], ["part", "seg", "doc_id", "at", "n_tokens", "x"])

    made = rows.select("part", "seg", "doc_ids", "counts", "blob").mapInArrow(run, f"part int, seg int, doc_id long, at long, n_tokens long, x {'array<int>' if whole else 'long'}")
    return made.join(place, ["part", "seg"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", F.col("x").alias("ids" if whole else "ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digests(spark, path)
