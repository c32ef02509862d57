"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def make_session(name: str = "tessella", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()
