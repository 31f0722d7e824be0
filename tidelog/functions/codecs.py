"""Byte codecs of the binary log and batch formats: fixed-width, varint and length-prefixed values."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed32(n: int) -> bytes:
    return struct.pack("<I", n)


def fixed64(n: int) -> bytes:
    return struct.pack("<Q", n)


def varint(n: int) -> bytes:
    """Seven bits a byte from the low end, the high bit set on all but the last."""
    if n < 0:
        raise ValueError("varints are unsigned")
    groups = [n >> s & 0x7F for s in range(0, max(n.bit_length(), 1), 7)]
    return bytes([*(g | 0x80 for g in groups[:-1]), groups[-1]])


def prefixed(data: bytes) -> bytes:
    return varint(len(data)) + data


@dataclass
class Cursor:
    """Reads values in order; after a value that the bytes do not hold whole it has failed and returns zeros or nothing."""

    data: bytes
    at: int = 0
    failed: bool = False

    def take(self, n: int) -> bytes:
        if self.failed or n > len(self.data) - self.at:
            self.failed = True
            return b""
        self.at += n
        return self.data[self.at - n : self.at]

    def fixed32(self) -> int:
        return int.from_bytes(self.take(4), "little")

    def fixed64(self) -> int:
        return int.from_bytes(self.take(8), "little")

    def varint(self) -> int:
        total = 0
        for shift in range(0, 70, 7):
            b = self.take(1)
            if not b:
                return 0
            total |= (b[0] & 0x7F) << shift
            if b[0] < 0x80:
                if total >> 64:
                    break
                return total
        self.failed = True
        return 0

    def prefixed(self) -> bytes:
        return self.take(self.varint())

    def done(self) -> bool:
        return not self.failed and self.at == len(self.data)


DELETION, VALUE = 0, 1


def encode_batch(ops: list[tuple[int, bytes, bytes]]) -> bytes:
    """A write batch: its number of operations, then kind, key and, for values, the value."""
    out = [varint(len(ops))]
    for kind, key, value in ops:
        out += [bytes([kind]), prefixed(key), prefixed(value) if kind == VALUE else b""]
    return b"".join(out)


def decode_batch(data: bytes) -> list[tuple[int, bytes, bytes]] | None:
    """The operations of a batch in order; None for an unknown kind, cut values or bytes behind the last operation."""
    c, ops = Cursor(data), []
    for _ in range(c.varint()):
        kind = int.from_bytes(c.take(1), "little")
        if c.failed or kind not in (DELETION, VALUE):
            return None
        key = c.prefixed()
        ops.append((kind, key, c.prefixed() if kind == VALUE else b""))
    return ops if c.done() else None


def varint_bytes(n: Column) -> Column:
    """The varint of a whole number; null of null."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else varint(x) for x in col.to_pylist()], pa.binary())

    return run(n.cast("long"))


def varint_value(data: Column) -> Column:
    """The number of a varint that the bytes hold whole; else null."""

    def value(x: bytes | None) -> int | None:
        c = Cursor(x or b"")
        n = c.varint()
        return n if c.done() else None

    @F.arrow_udf("long")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([value(x) for x in col.to_pylist()], pa.int64())

    return run(data)


def batch_bytes(key: Column, value: Column) -> Column:
    """A write batch of one operation: a put of the value, or a deletion where it is null."""

    @F.arrow_udf("binary")
    def run(keys: pa.Array, values: pa.Array) -> pa.Array:
        ops = zip(keys.to_pylist(), values.to_pylist(), strict=True)
        return pa.array([encode_batch([(DELETION, k, b"") if v is None else (VALUE, k, v)]) for k, v in ops], pa.binary())

    return run(key.cast("binary"), value.cast("binary"))
