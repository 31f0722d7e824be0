"""Session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, because histories and events are compared across machines; ANSI, because a silent overflow would corrupt a log.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "tidelog", **more: str) -> SparkSession:
    """A session with the settings above; the master and cluster sizes come from outside."""
    return SparkSession.builder.appName(name).config(map={**SETTINGS, **more}).getOrCreate()
