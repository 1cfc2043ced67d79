"""A session with the settings that the library's queries are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "logweave", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", os.environ.get("LOGWEAVE_SHUFFLE_PARTITIONS", "8"))
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
