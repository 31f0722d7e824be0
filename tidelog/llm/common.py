"""Shared helpers of the corpus operators: temporary tables, row keys, word hashes, samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOCAL: dict[str, str] = {}
_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one and runs in one process (tests, a laptop) a folder of that process is made and set. On a cluster a folder of the driver's
    machine would be no shared one, so there it must be named.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def keep(df: DataFrame) -> DataFrame:
    """Writes a frame as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks that were running, not the stages before them.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has kept so far, once results that were read from them are stored; returns how many."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    n = len(_KEPT)
    while _KEPT:
        path = hadoop(_KEPT.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(col: str = "text") -> Column:
    """Tells rows of one doc_id apart; null and empty texts differ."""
    return F.when(F.col(col).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(col)))


def same_row(a: DataFrame, b: DataFrame, id_a: str, h_a: str, id_b: str, h_b: str) -> Column:
    return a[id_a].eqNullSafe(b[id_b]) & (a[h_a] == b[h_b])


def bounded_sample(df: DataFrame, by: str, ident: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``by``, those with the smallest hash of ``ident``.

    A first pass counts the values; the second keeps rows whose hash lies under each value's
    threshold, so that hardly more than the sample is shuffled, whatever share one value holds.
    """
    rank = F.pmod(F.xxhash64(F.col(ident), F.lit("sample")), F.lit(1 << 32))
    counts = df.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__n"))
    share = F.least(F.lit(1.0), F.lit(1.25 * most + 50) / F.col("__n"))
    near = (
        df.join(F.broadcast(counts), F.col(by) == F.col("__by"))
        .withColumn("__rank", rank)
        .where(F.col("__rank") < share * F.lit(float(1 << 32)))
    )
    order = Window.partitionBy(by).orderBy("__rank", ident, F.xxhash64(*df.columns))
    return near.withColumn("__pos", F.row_number().over(order)).where(F.col("__pos") <= most).drop("__by", "__n", "__rank", "__pos")


# --- bytes and words of a batch -----------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG_WORD = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_parts(col: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string or binary array into runs of rows of about ``most`` bytes.

    Yields (first row, bytes, row offsets into the bytes); null counts as empty. A row is never cut.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(raw: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without bytes of ``between``, white space at first), and each word's row."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    blank = between[raw]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = blank[:-1]
    inner = off[:-1][off[:-1] < len(raw)]
    before[inner] = True
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = blank[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = True
    starts, stops = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return starts, stops, np.searchsorted(off, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words at once."""
    size = stops - starts
    h = mix64(size.astype(np.uint64) + _M1)
    if not len(size):
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    todo, at = np.flatnonzero(size <= _LONG_WORD), 0
    while len(todo):
        left = size[todo] - at
        word = np.ascontiguousarray(eight[starts[todo] + at]).view(np.uint64).ravel()
        h[todo] = mix64((h[todo] ^ (word & _MASK[np.minimum(left, 8)])) * _M1 + _M2)
        at += 8
        todo = todo[left > 8]
    for k in np.flatnonzero(size > _LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(raw[starts[k] : stops[k]].tobytes())
    return h


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
