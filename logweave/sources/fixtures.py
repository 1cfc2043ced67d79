"""Canonical tables derived from the relational fixtures, and the same derivations as SQL for the oracle.

`events` stands in for every log: sequence numbers and log indexes are event_id + 1, keys are user ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _micros():
    return F.round(F.col("value") * 1000).cast("bigint")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key = user_id, value = micros, tombstone for event type error."""
    e = events(spark, sf_dir)
    return e.select(
        F.format_string("user%012d", "user_id").cast("binary").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") != "error", _micros().cast("string").cast("binary")).alias("value"),
    )


LOG = """log AS (SELECT printf('user%012d', user_id) AS key, event_id + 1 AS seq,
  CASE WHEN event_type <> 'error' THEN CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR) END AS value FROM events)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_commands(events(spark, sf_dir))


def as_commands(e: DataFrame) -> DataFrame:
    """Sessions are users (0 for each 50th event, which has no deduplication); client sequence numbers repeat and go back."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").otherwise("cas")
    return e.select(
        (i + 1).alias("log_index"),
        F.when(i % 50 == 0, 0).otherwise(F.col("user_id") + 1).cast("bigint").alias("session_id"),
        (F.floor(i / 20) + i % 3).cast("bigint").alias("client_seq"),
        kind.alias("op"),
        F.format_string("k%03d", i * 7 % 40).alias("key"),
        (i % 4).cast("string").alias("value"),
        F.when(i % 5 != 0, (i % 4).cast("string")).alias("expect"),
        F.when(i % 11 != 0, (i * 3 % 4).cast("string")).alias("new"),
    )


COMMANDS = """commands AS (SELECT event_id + 1 AS log_index, CASE WHEN event_id % 50 = 0 THEN 0 ELSE user_id + 1 END AS session_id,
  event_id // 20 + event_id % 3 AS client_seq,
  CASE event_type WHEN 'purchase' THEN 'put' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'get' ELSE 'cas' END AS op,
  printf('k%03d', event_id * 7 % 40) AS key, CAST(event_id % 4 AS VARCHAR) AS value,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 4 AS VARCHAR) END AS expect, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id * 3 % 4 AS VARCHAR) END AS new FROM events)"""


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nodes' logs: node n lacks the last 37 (n - 1) entries, and node 3 has other terms from 40 entries before
    its end on; payload is the event's type."""
    e = events(spark, sf_dir)
    last = e.agg((F.max("event_id") + 1).alias("last"))
    node = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("node")
    rows = e.join(F.broadcast(last)).select(node, (F.col("event_id") + 1).alias("index"), "event_type", "last")
    rows = rows.withColumn("end", F.col("last") - 37 * (F.col("node") - 1)).where("index <= end")
    wrong = (F.col("node") == 3) & (F.col("index") > F.col("end") - 40)
    kind = F.when(F.col("index") % 500 == 1, "noop").when(F.col("index") % 700 == 3, "conf").otherwise("normal")
    return rows.select("node", "index", (F.floor(F.col("index") / 1000) + F.when(wrong, 0).otherwise(1)).cast("bigint").alias("term"), kind.alias("kind"), F.when(wrong, "other").otherwise(F.col("event_type")).alias("payload"))


REPLICAS = """replicas AS (SELECT node, index, index // 1000 + CASE WHEN wrong THEN 0 ELSE 1 END AS term,
  CASE WHEN index % 500 = 1 THEN 'noop' WHEN index % 700 = 3 THEN 'conf' ELSE 'normal' END AS kind, CASE WHEN wrong THEN 'other' ELSE event_type END AS payload
  FROM (SELECT *, node = 3 AND index > stop - 40 AS wrong FROM (
    SELECT n.node, event_id + 1 AS index, event_type, max(event_id + 1) OVER () - 37 * (n.node - 1) AS stop FROM events, (VALUES (1::BIGINT), (2), (3)) n(node)) WHERE index <= stop))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples by operation kind, and whether the operation failed."""
    return events(spark, sf_dir).select(F.col("event_type").alias("kind"), _micros().alias("micros"), (F.col("event_type") == "error").alias("failed"), "ts")


SAMPLES = "samples AS (SELECT event_type AS kind, CAST(round(value * 1000) AS BIGINT) AS micros, event_type = 'error' AS failed, ts FROM events)"


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table catalog: 500 log entries a table, levels 0 to 2."""
    log = mutations(spark, sf_dir)
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 24
    rows = log.groupBy(F.floor((F.col("seq") - 1) / 500).alias("id")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"), F.max("seq").alias("max_seq"))
    return rows.withColumn("level", (F.col("id") % 3).cast("int"))


TABLES = (
    LOG
    + """, tables AS (SELECT (seq - 1) // 500 AS id, min(key) AS min_key, max(key) AS max_key, count(*) AS entries,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 24) AS BIGINT) AS bytes, max(seq) AS max_seq, CAST((seq - 1) // 500 % 3 AS INT) AS level FROM log GROUP BY (seq - 1) // 500)"""
)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """A regression file: blank lines and comments are skipped, a line's first token is the seed."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+")[0].cast("bigint").alias("seed"))
