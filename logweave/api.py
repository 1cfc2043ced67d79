"""A store over a Parquet mutation log: puts, deletes, batches, swaps, reads at any snapshot, and compaction.

Each write adds a file set of its own under the path; nothing is changed in place. One writer at a time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import commands, mvcc


def _key(key: str | bytes | None) -> bytes | None:
    return key.encode() if isinstance(key, str) else key


class Backend(Protocol):
    """What a fold of commands needs of a state: rows are (key, value) frames."""

    def get(self, key: str | bytes, snapshot: int | None = None) -> bytes | None: ...

    def write(self, ops: Sequence[tuple[str | bytes, str | bytes | None]]) -> int: ...

    def scan(self, start: str | bytes | None = None, end: str | bytes | None = None, limit: int | None = None, snapshot: int | None = None) -> DataFrame: ...

    def dump(self) -> DataFrame: ...

    def clear_and_load(self, rows: DataFrame) -> int: ...


class Store:
    """A Backend over Parquet files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Store:
        spark.createDataFrame([], "key binary, seq bigint, value binary").write.mode("errorifexists").parquet(path)
        return cls(spark, path)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str) -> Store:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return cls(spark, path) if there else cls.create(spark, path)

    def log(self) -> DataFrame:
        return self.spark.read.schema("key binary, seq bigint, value binary").parquet(self.path)

    def seq(self) -> int:
        """The last sequence number; 0 if nothing was written. As a snapshot it pins what is visible now."""
        return self.log().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]

    def write(self, ops: Sequence[tuple[str | bytes, str | bytes | None]]) -> int:
        """One atomic batch; a None value deletes. Returns the last sequence number."""
        last = self.seq()
        if not ops:
            return last
        rows = [(_key(k), last + 1 + i, _key(v)) for i, (k, v) in enumerate(ops)]
        self.spark.createDataFrame(rows, "key binary, seq bigint, value binary").write.mode("append").parquet(self.path)
        return last + len(ops)

    def put(self, key: str | bytes, value: str | bytes) -> int:
        return self.write([(key, value)])

    def delete(self, key: str | bytes) -> int:
        return self.write([(key, None)])

    def get(self, key: str | bytes, snapshot: int | None = None) -> bytes | None:
        row = mvcc.get(self.log(), _key(key), snapshot).first()
        return None if row["value"] is None else bytes(row["value"])

    def cas(self, key: str | bytes, expect: str | bytes | None, new: str | bytes | None) -> tuple[bool, bytes | None]:
        """Swap if the value is `expect` (None: absent); returns success and the value observed."""
        now = self.get(key)
        if now != _key(expect):
            return False, now
        self.write([(key, new)])
        return True, now

    def scan(self, start: str | bytes | None = None, end: str | bytes | None = None, limit: int | None = None, snapshot: int | None = None) -> DataFrame:
        return mvcc.scan(self.log(), _key(start), _key(end), limit, snapshot)

    def dump(self) -> DataFrame:
        """All live rows."""
        return mvcc.dump(self.log())

    def clear_and_load(self, rows: DataFrame) -> int:
        """Delete every key that rows (key, value) lack and put all rows, as one batch."""
        seq = self.seq() + 1
        log = self.log()
        new = mvcc.replace_all(log.limit(0), rows, seq).unionByName(mvcc.tombstones(log, rows, seq))
        new.write.mode("append").parquet(self.path)
        return seq

    def compact(self, path: str, pins: Sequence[int] = (), files: int = 8) -> Store:
        """The store at a new path without versions that neither the pins nor the present need."""
        from logweave.operators.maintenance import write_tables

        horizon = min(pins, default=self.seq())
        write_tables(mvcc.collect_garbage(self.log(), horizon, bottom=True), path, files)
        return Store(self.spark, path)

    def apply(self, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Fold a command log over the live state (text keys and values): results and the new state."""
        text = [F.col(c).cast("string").alias(c) for c in ("key", "value")]
        return commands.apply(log, mvcc.dump(self.log()).select(*text))
