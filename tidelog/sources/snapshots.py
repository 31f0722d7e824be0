"""State snapshots: a folder for each version and a manifest that is swapped last, so readers see whole versions only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.schemas import KV_STATE
from tidelog.sources.files import Manifests

LAST_SEQ = "part INT, client_id BIGINT, last_seq BIGINT"


class Snapshots:
    """Versions of (state, last_seq) under a path that any Hadoop file system serves."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.manifests = Manifests(path)

    def committed(self, spark: SparkSession) -> int:
        """The id of the last committed batch, -1 before the first."""
        found = self.manifests.newest(spark)
        return found[0] if found else -1

    def load(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        found = self.manifests.newest(spark)
        if not found:
            return spark.createDataFrame([], KV_STATE), spark.createDataFrame([], LAST_SEQ)
        at = f"{self.path}/{found[1]['folder']}"
        return spark.read.schema(KV_STATE).parquet(f"{at}/state"), spark.read.schema(LAST_SEQ).parquet(f"{at}/last_seq")

    def commit(self, spark: SparkSession, batch: int, state: DataFrame, last_seq: DataFrame) -> None:
        """Writes a version and makes it the newest. What a failed attempt leaves behind is never read."""
        folder = f"v{batch:012d}-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.path}/{folder}/state")
        last_seq.write.parquet(f"{self.path}/{folder}/last_seq")
        self.manifests.commit(spark, batch, {"folder": folder})
