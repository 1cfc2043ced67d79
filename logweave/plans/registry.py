"""All registered queries of the reference operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.plans import bench, cmd, consensus, kv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = kv.QUERIES | cmd.QUERIES | consensus.QUERIES | bench.QUERIES
ORACLE_SQL: dict[str, str] = kv.ORACLE_SQL | cmd.ORACLE_SQL | consensus.ORACLE_SQL | bench.ORACLE_SQL
