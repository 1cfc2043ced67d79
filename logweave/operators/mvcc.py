"""Multi-version reads over a mutation log (key, seq, value): a null value is a tombstone.

The order is (key ascending, seq descending). The snapshot bound and key bounds are applied before versions are
ranked, so they reach the scan; value predicates and the live filter come after, or older versions would reappear.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _literal(key: Any) -> Column:
    return key if isinstance(key, Column) else F.lit(key)


def up_to(log: DataFrame, snapshot: int | None) -> DataFrame:
    """Versions with seq <= snapshot; all of them without a snapshot. A snapshot beyond the last version is allowed."""
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def in_range(log: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Keys from start (inclusive) to end (exclusive); none for an open bound."""
    if start is not None:
        log = log.where(F.col("key") >= _literal(start))
    return log if end is None else log.where(F.col("key") < _literal(end))


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of each key at the snapshot, tombstones included."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return up_to(log, snapshot).withColumn("_version", newest).where("_version = 1").drop("_version")


def live(view: DataFrame) -> DataFrame:
    """A visible view without tombstones. An empty value is alive."""
    return view.where("value is not null")


def get(log: DataFrame, key: Any, snapshot: int | None = None) -> DataFrame:
    """One row (key, status, value): status is live, tombstone or missing."""
    found = up_to(log, snapshot).where(F.col("key") == _literal(key))
    last = F.max_by(F.struct("seq", "value"), "seq").alias("last")
    return found.agg(last).select(_literal(key).alias("key"), _status(F.col("last")), F.col("last.value").alias("value"))


def _status(last: Column) -> Column:
    return F.when(last.isNull(), "missing").when(last["value"].isNull(), "tombstone").otherwise("live").alias("status")


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(key, status, value) of each distinct key asked for."""
    keys = keys.select("key").distinct()
    found = up_to(log, snapshot).join(keys, "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("seq", "value"), "seq").alias("last"))
    return keys.join(found, "key", "left").select("key", _status(F.col("last")), F.col("last.value").alias("value"))


def scan(log: DataFrame, start: Any = None, end: Any = None, limit: int | None = None, snapshot: int | None = None) -> DataFrame:
    """Live keys of a range in key order, `limit` of them at most (0 gives none)."""
    rows = live(visible(in_range(log, start, end), snapshot)).select("key", "value").orderBy("key")
    return rows if limit is None else rows.limit(limit)


def dump(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return live(visible(log, snapshot)).select("key", "value")


def versions(log: DataFrame) -> DataFrame:
    """All versions in the canonical order."""
    return log.orderBy("key", F.desc("seq"))


def merge(*sources: DataFrame) -> DataFrame:
    """Versions of several sources; a version that several hold (replay overlaps) counts once."""
    return reduce(DataFrame.unionByName, sources).dropDuplicates(["key", "seq"])


def horizon(log: DataFrame, pins: DataFrame) -> DataFrame:
    """One row (horizon): the oldest pinned snapshot, else the last sequence number."""
    oldest = pins.agg(F.min("seq").alias("pinned"))
    last = log.agg(F.max("seq").alias("last"))
    return oldest.join(F.broadcast(last)).select(F.coalesce("pinned", "last").alias("horizon"))  # one row each


def pinned(events: DataFrame) -> DataFrame:
    """events (seq, delta: 1 when a snapshot is taken, -1 when one is released) to the sequence numbers still pinned."""
    return events.groupBy("seq").agg(F.sum("delta").alias("count")).where("count > 0")


def collect_garbage(log: DataFrame, horizon: int, bottom: bool = False) -> DataFrame:
    """All versions above the horizon, and the newest at or below it; at the bottom level a tombstone there goes too."""
    # versions above the horizon are not ranked, so they are not shuffled
    baseline = visible(log, horizon)
    return log.where(F.col("seq") > horizon).unionByName(live(baseline) if bottom else baseline)


def number_batches(batches: DataFrame) -> DataFrame:
    """Write batches (first_seq, ops) as versions: op i has seq first_seq + i; an empty batch has none."""
    ops = batches.select("first_seq", F.posexplode("ops").alias("i", "op"))
    return ops.select("op.key", (F.col("first_seq") + F.col("i")).alias("seq"), "op.value")


def append(log: DataFrame, ops: Sequence[tuple[Any, Any]], first_seq: int) -> DataFrame:
    """The log with a batch of (key, value or None) after it; a later op of the batch wins. No ops: the same log."""
    if not ops:
        return log
    kinds = dict(log.dtypes)
    rows = log.sparkSession.createDataFrame([(k, first_seq + i, v) for i, (k, v) in enumerate(ops)], f"key {kinds['key']}, seq bigint, value {kinds['value']}")
    return log.unionByName(rows)


def put(log: DataFrame, key: Any, value: Any, seq: int) -> DataFrame:
    return append(log, [(key, value)], seq)


def delete(log: DataFrame, key: Any, seq: int) -> DataFrame:
    """A tombstone; the key need not exist."""
    return append(log, [(key, None)], seq)


def tombstones(log: DataFrame, rows: DataFrame, seq: int) -> DataFrame:
    """Deletes of every live key of the log that rows lack."""
    return dump(log).join(rows, "key", "left_anti").select("key", F.lit(seq).cast("bigint").alias("seq"), F.lit(None).cast(dict(log.dtypes)["value"]).alias("value"))


def replace_all(log: DataFrame, rows: DataFrame, seq: int) -> DataFrame:
    """The log after a batch that deletes every live key that rows lack and puts all rows (key, value).

    The batch has sequence number seq, or the one after the log's last if the log has come to seq or beyond: a batch
    comes after all that it replaces."""
    after = log.agg(F.greatest(F.lit(seq).cast("bigint"), F.max("seq") + 1).alias("seq"))
    batch = tombstones(log, rows, seq).drop("seq").unionByName(rows.select("key", "value"))
    return log.unionByName(batch.join(F.broadcast(after)).select(*log.columns))  # one row


def position(log: DataFrame) -> DataFrame:
    """One row: last sequence number, versions, bytes in memory, smallest and largest key."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 24
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"), F.count(F.lit(1)).alias("versions"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def literal_log(spark: SparkSession, rows: Sequence[tuple[Any, int, Any]]) -> DataFrame:
    """A log from (key, seq, value or None), keys and values as text; the in-memory test double."""
    return spark.createDataFrame([(k.encode(), s, None if v is None else v.encode()) for k, s, v in rows], "key binary, seq bigint, value binary")
