"""Reading vectors: which rows take part, and numpy matrices of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taking_part(df: DataFrame, ident: str, col: str) -> DataFrame:
    """(id, x array<double>) of the rows with an id and a vector that is not null, empty or zero and holds no null or non-finite component."""
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))


def usable(df: DataFrame, ident: str, col: str) -> tuple[DataFrame, int]:
    """(id, x array<double>) of the vectors that take part, and their length.

    A vector that is null, zero, or holds a null or non-finite component takes no part, nor does one whose length is not the
    commonest (of equally common lengths the greatest), nor a row without an id.
    """
    rows = taking_part(df, ident, col)
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top.d if top else 0
    return rows.where(F.size("x") == d), d


def matrix(col: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of equal rows in double precision, added component by component."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out
