"""Write-ahead log files: framed records with checksums, as a data source, a writer and DataFrame rules.

A record is crc32 of the payload, its length (both little-endian, 32 bits) and the payload. A reader takes the intact prefix of a file and
stops at the first record that is short or whose checksum is wrong.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.functions.codecs import VALUE, decode_batch

HEADER = struct.Struct("<II")
_ROW = "path string, pos long, offset long, payload binary"


def frame(payload: bytes) -> bytes:
    return HEADER.pack(zlib.crc32(payload), len(payload)) + payload


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the intact prefix."""
    at = 0
    while at + HEADER.size <= len(data):
        crc, size = HEADER.unpack_from(data, at)
        payload = data[at + HEADER.size : at + HEADER.size + size]
        if len(payload) < size or zlib.crc32(payload) != crc:
            return
        yield at, payload
        at += HEADER.size + size


def good_offset(data: bytes) -> int:
    """Where the intact prefix ends."""
    last = None
    for last in records(data):  # noqa: B007
        pass
    return 0 if last is None else last[0] + HEADER.size + len(last[1])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, offset, payload) of the intact records of log files, read by Spark from any store; a file is one row of its binary source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = list(records(data.as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([o for o, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], ["path", "pos", "offset", "payload"]
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ROW)


def intact_prefix(rows: DataFrame, by: list[str], pos: str, crc: str, payload: str) -> DataFrame:
    """Rows of framed records before the first whose checksum is wrong, for records that are already in a table.

    The first bad position is a minimum for each log, so logs are not sorted.
    """
    bad = rows.where(F.crc32(F.col(payload).cast("binary")) != F.col(crc)).groupBy(*by).agg(F.min(pos).alias("__bad"))
    return rows.join(bad, by, "left").where(F.col("__bad").isNull() | (F.col(pos) < F.col("__bad"))).drop("__bad")


def intact_prefix_by_flag(rows: DataFrame, by: list[str], pos: str, ok: str) -> DataFrame:
    """The same for rows that carry a flag; a null flag counts as bad."""
    bad = rows.where(~F.coalesce(F.col(ok), F.lit(False))).groupBy(*(F.col(c).alias(f"__of_{c}") for c in by)).agg(F.min(pos).alias("__bad"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(bad, same, "left").where(F.col("__bad").isNull() | (F.col(pos) < F.col("__bad"))).select(*rows.columns)


def operations(logged: DataFrame) -> DataFrame:
    """(path, pos, nth, op, k, v): the operations of each record's write batch, in order; a record that is no batch raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, int, int, str, bytes, bytes | None]] = []
            for name, pos, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ops = decode_batch(payload)
                if ops is None:
                    raise ValueError(f"record {pos} of {name} is no write batch")
                out += [(name, pos, n, "put" if kind == VALUE else "delete", k, v if kind == VALUE else None) for n, (kind, k, v) in enumerate(ops)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "pos", "nth", "op", "k", "v"])

    return logged.select("path", "pos", "payload").mapInArrow(run, "path string, pos long, nth int, op string, k binary, v binary")


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator[tuple[str, int, int, bytes]]:
        with open(partition.path, "rb") as f:
            for pos, (offset, payload) in enumerate(records(f.read())):
                yield partition.path, pos, offset, payload


class WalSource(DataSource):
    """``spark.read.format("tidewal").load(path)`` for log files on paths that every executor mounts; commas part several. For other stores use ``read``."""

    @classmethod
    def name(cls) -> str:
        return "tidewal"

    def schema(self) -> str:
        return _ROW

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)
