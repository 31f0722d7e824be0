"""Rows of a Spark query against rows of the SQL that should give the same, as DuckDB runs it over the same files."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(x: object) -> object:
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return x


def rows(found: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


KINDS = {"HUGEINT": "huge", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "SMALLINT": "smallint"}


def assert_same(df: DataFrame, c: duckdb.DuckDBPyConnection, sql: str) -> int:
    want = c.execute(sql)
    names, kinds = [d[0] for d in want.description], [KINDS.get(str(d[1]), str(d[1])) for d in want.description]
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert dict(df.dtypes) == dict(zip(names, kinds, strict=True))
    expected, got = rows(want.fetchall(), names), rows([tuple(r) for r in df.collect()], df.columns)
    assert len(got) == len(expected), (len(got), len(expected))
    for a, b in zip(got, expected, strict=True):
        assert a == b, (a, b)
    return len(got)
