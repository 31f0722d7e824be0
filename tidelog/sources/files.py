"""Small files on any Hadoop file system: numbered manifests that are written once and never changed."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Manifests:
    """JSON manifests under a path. The one with the highest number counts; a number can be taken once."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def _at(self, spark: SparkSession, name: str = ""):  # noqa: ANN202
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def newest(self, spark: SparkSession) -> tuple[int, Any] | None:
        root, fs = self._at(spark)
        if not fs.exists(root):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        numbers = [int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")]
        if not numbers:
            return None
        text = spark.read.text(f"{self.path}/manifest-{max(numbers):012d}", wholetext=True).first()
        return max(numbers), json.loads(text[0]) if text else None

    def commit(self, spark: SparkSession, number: int, content: Any) -> None:
        """Writes another file and renames it; raises RuntimeError if the number is taken."""
        draft, fs = self._at(spark, f".draft-{uuid.uuid4().hex}")
        final, _ = self._at(spark, f"manifest-{number:012d}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"manifest {number} was committed by another writer")
