"""The corpus queries of __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import embedding_dedup, language_id, line_dedup, mixing, near_dedup, neighbours, packing, pii, suffix_dedup, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_length_buckets": packing.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_dart_minhash": near_dedup.query,
    "op5_soft_mixing": mixing.query,
    "op6_line_dedup": line_dedup.query,
    "op7_neighbours": neighbours.query,
    "op8_token_files": token_files.query,
    "op9_embedding_dedup": embedding_dedup.query,
    "op10_pii": pii.query,
}

SQL: dict[str, str] = {
    "op6_line_dedup": line_dedup.SQL,
    "op7_neighbours": neighbours.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
}
