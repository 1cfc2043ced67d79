"""The command log applied as a stream: session de-duplication as keyed state, and tables of micro-batches.

State is never dropped, as in the engine: it has one number per session. Session 0 has no state. Event order within a
session comes from the log index; the source must deliver a session's commands in order across micro-batches (see
`ordered` for sources that don't).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

STATUS_SCHEMA = "log_index bigint, session_id bigint, client_seq bigint, status string"


def _dedup(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Statuses of one session's new commands; only (log_index, client_seq) of a micro-batch are held for sorting."""
    session = key[0]
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches), ignore_index=True).sort_values("log_index")
    out = []
    for seq in rows["client_seq"]:
        if session == 0 or last is None or seq > last:
            status, last = "applied", int(seq)
        else:
            status = "duplicate" if seq == last else "stale"
        out.append(status)
    if session != 0:
        state.update((last,))
    yield pd.DataFrame({"log_index": rows["log_index"], "session_id": session, "client_seq": rows["client_seq"], "status": out})


def statuses(commands: DataFrame) -> DataFrame:
    """A streaming frame of commands to one of statuses. Session 0 needs no state and is decided without a shuffle."""
    columns = [x.split()[0] for x in STATUS_SCHEMA.split(", ")]
    free = commands.where("session_id = 0").withColumn("status", F.lit("applied")).select(*columns)
    kept = commands.where("session_id != 0").select("log_index", "session_id", "client_seq")
    marked = kept.groupBy("session_id").applyInPandasWithState(_dedup, STATUS_SCHEMA, "last bigint", "append", GroupStateTimeout.NoTimeout)
    return marked.select(*columns).union(free)


def log_source(spark: SparkSession, path: str, schema: StructType | str, files: int = 64) -> DataFrame:
    """A table of Parquet files as a stream whose micro-batches take at most `files` new files each."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_statuses(commands: DataFrame, out: str, checkpoint: str) -> None:
    """Apply everything that the source has now, and stop; a later call goes on from the checkpoint."""
    query = statuses(commands).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def append_log(batches: DataFrame, out: str, checkpoint: str) -> None:
    """Mutations of a stream appended to a log table; the file sink commits each micro-batch as a whole."""
    query = batches.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(samples: DataFrame, late: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """(second, kind, n) of a stream of samples (ts, kind), rows later than `late` behind dropped (extension)."""
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("second"), "kind", "n")
