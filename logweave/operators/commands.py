"""The deterministic command fold: session de-duplication, put, delete, compare-and-swap and logged reads.

Whether a command is applied depends on its session's sequence numbers only, never on results; so sessions are
decided first (the largest number so far, by runs of the log), and applied commands are folded by key after. What a run
of one key's commands does to the value before it is a function of that value: constant once the run has a put or
delete, else a short list of values that swaps move. These functions are chained along each key's runs, and all runs
are then replayed in parallel, so a hot key or session is spread over as many tasks as it has runs. Absent equals absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Log entries of a run.
RUN = 1 << 16


def statuses(commands: DataFrame, run: int = RUN) -> DataFrame:
    """commands with status: applied, duplicate (the last number again) or stale (a smaller one); session 0 is exempt.
    answer_index is the log index whose result answers the command; null for a stale one."""
    # session 0 has no order to keep; -log_index picks the first of equal numbers
    c = commands.withColumn("_run", F.floor(F.col("log_index") / run)).withColumn("_mark", F.when(F.col("session_id") != 0, F.struct("client_seq", (-F.col("log_index")).alias("i"))))
    ends = c.groupBy("session_id", "_run").agg(F.max("_mark").alias("_end"))
    earlier = Window.partitionBy("session_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("session_id", "_run", F.max("_end").over(earlier).alias("_carried"))
    inner = Window.partitionBy("session_id", "_run").orderBy("log_index").rowsBetween(Window.unboundedPreceding, -1)
    known = c.withColumn("_inner", F.max("_mark").over(inner)).join(ends, ["session_id", "_run"]).withColumn("_last", F.greatest("_inner", "_carried"))
    last = F.col("_last.client_seq")
    status = F.when(last.isNull() | (F.col("client_seq") > last), "applied").when(F.col("client_seq") == last, "duplicate").otherwise("stale")
    answer = F.when(F.col("status") == "applied", F.col("log_index")).when(F.col("status") == "duplicate", -F.col("_last.i"))
    return known.withColumn("status", status).withColumn("answer_index", answer).select(*commands.columns, "status", "answer_index")


def validated(commands: DataFrame) -> DataFrame:
    """Writes without a session are rejected at the server; `error` says so, else it is null."""
    return commands.withColumn("error", F.when((F.col("session_id") == 0) & (F.col("op") != "get"), "session required"))


class _Effect:
    """What a run of one key's commands makes of the value before it: `fixed` once a put or delete came, else the
    values in `start` end as those in `end`, and all others stay. Values that meet stay together, so they are moved as
    one group."""

    def __init__(self) -> None:
        self.fixed, self.value = False, None
        self.at: dict[str | None, list[str | None]] = {}
        self.known: set[str | None] = set()

    def _group(self, value: str | None) -> list[str | None]:
        found = self.at.setdefault(value, [])
        if value not in self.known:
            self.known.add(value)
            found.append(value)
        return found

    def add(self, op: str, value: str | None, expect: str | None, new: str | None) -> None:
        if op in ("put", "delete"):
            self.fixed, self.value = True, value if op == "put" else None
        elif op == "cas" and self.fixed:
            self.value = new if self.value == expect else self.value
        elif op == "cas" and expect != new:
            moved, there = self._group(expect), self._group(new)
            # the smaller group joins the larger one
            there, moved = (there, moved) if len(there) >= len(moved) else (moved, there)
            there += moved
            self.at[new] = there
            del self.at[expect]

    def moves(self) -> list[dict[str, str | None]]:
        return [{"start": s, "end": e} for e, group in self.at.items() for s in group if s != e]


_MOVES = pa.list_(pa.struct([("start", pa.string()), ("end", pa.string())]))
_EFFECT = pa.schema([("key", pa.string()), ("run", pa.int64()), ("fixed", pa.bool_()), ("value", pa.string()), ("moves", _MOVES)])
_BATCH = 4096


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The effect of each (key, run); rows come by key, run and log index."""
    now, effect, out = None, _Effect(), []

    def done() -> dict[str, Any]:
        return {"key": now[0], "run": now[1], "fixed": effect.fixed, "value": effect.value, "moves": [] if effect.fixed else effect.moves()}

    for batch in batches:
        for key, run, op, value, expect, new in zip(*(batch[c].to_pylist() for c in ("key", "run", "op", "value", "expect", "new"))):
            if now != (key, run):
                if now is not None:
                    out.append(done())
                now, effect = (key, run), _Effect()
            effect.add(op, value, expect, new)
        if len(out) >= _BATCH:
            yield pa.RecordBatch.from_pylist(out, _EFFECT)
            out = []
    if now is not None:
        out.append(done())
    if out:
        yield pa.RecordBatch.from_pylist(out, _EFFECT)


_START = pa.schema([("key", pa.string()), ("run", pa.int64()), ("start", pa.string()), ("after", pa.string())])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The value before and after each (key, run); rows come by key and run."""
    now, value = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is None or now[0] != row["key"]:
                now, value = (row["key"],), None
            start = value
            value = row["value"] if row["fixed"] else next((m["end"] for m in row["moves"] if m["start"] == value), value)
            out.append({"key": row["key"], "run": row["run"], "start": start, "after": value})
        if out:
            yield pa.RecordBatch.from_pylist(out, _START)


_RESULT = pa.schema([("log_index", pa.int64()), ("result", pa.string()), ("success", pa.bool_()), ("actual", pa.string())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each command; rows come by key, run and log index, with the value before the run."""
    now, held = None, None
    for batch in batches:
        at, result, success, actual = [], [], [], []
        for key, run, start, i, op, value, expect, new in zip(*(batch[c].to_pylist() for c in ("key", "run", "start", "log_index", "op", "value", "expect", "new"))):
            if now != (key, run):
                now, held = (key, run), start
            seen = held
            if op in ("put", "delete"):
                held = value if op == "put" else None
            elif op == "cas" and held == expect:
                held = new
            if i > 0:
                at.append(i)
                result.append("cas" if op == "cas" else "value" if op == "get" else "ok")
                success.append(seen == expect if op == "cas" else None)
                actual.append(seen if op in ("cas", "get") else None)
        if at:
            yield pa.record_batch([pa.array(x, k) for x, k in zip((at, result, success, actual), _RESULT.types)], schema=_RESULT)


def fold(commands: DataFrame, base: DataFrame | None = None, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Results of applied commands, and the final live state (key, value). `base` is a state (key, value) to start from.

    Results have log_index, result (ok, cas or value), success and actual: the value a swap or read observed."""
    rows = commands.select("log_index", "key", "op", "value", "expect", "new")
    if base is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(base.select(F.lit(0).cast("bigint").alias("log_index"), "key", F.lit("put").alias("op"), "value", none.alias("expect"), none.alias("new")))
    rows = rows.withColumn("run", F.floor(F.col("log_index") / run)).repartition("key", "run")
    effects = rows.sortWithinPartitions("key", "run", "log_index").mapInArrow(_effects, "key string, run long, fixed boolean, value string, moves array<struct<start: string, end: string>>")
    starts = effects.repartition("key").sortWithinPartitions("key", "run").mapInArrow(_starts, "key string, run long, start string, after string")
    results = rows.join(starts.select("key", "run", "start"), ["key", "run"]).sortWithinPartitions("key", "run", "log_index").mapInArrow(_replay, "log_index long, result string, success boolean, actual string")
    state = starts.groupBy("key").agg(F.max_by("after", "run").alias("value")).where("value is not null")
    return results, state


def apply(commands: DataFrame, base: DataFrame | None = None, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """One row per command: its status, and the result that the client sees (of the first application for a duplicate);
    and the final state."""
    marked = statuses(commands, run)
    results, state = fold(marked.where("status = 'applied'"), base, run)
    answers = results.withColumnRenamed("log_index", "answer_index")
    joined = marked.select("log_index", "session_id", "client_seq", "status", "answer_index").join(answers, "answer_index", "left")
    return joined.select("log_index", "session_id", "client_seq", "status", F.coalesce("result", F.lit("stale")).alias("result"), "success", "actual"), state


def responses(results: DataFrame) -> DataFrame:
    """Results as responses: ok, value and cas pass through, stale becomes an error."""
    return results.withColumn("error", F.when(F.col("result") == "stale", "stale sequence number"))


def cached(commands: DataFrame) -> DataFrame:
    """Each duplicate with the log index of the command whose result it gets."""
    return statuses(commands).where("status = 'duplicate'").select("log_index", "session_id", "client_seq", F.col("answer_index").alias("first_index"))


def sessions(commands: DataFrame) -> DataFrame:
    """The session table: last applied sequence number, and where it was applied; session 0 is not kept."""
    applied = statuses(commands).where("status = 'applied' and session_id != 0")
    return applied.groupBy("session_id").agg(F.max("client_seq").alias("last_seq"), F.max_by("log_index", "client_seq").alias("last_index"))


def progress(entries: DataFrame) -> DataFrame:
    """The applied index and the number of commands by node: noops and membership changes advance the index only."""
    return entries.groupBy("node").agg(F.max("index").alias("applied_index"), F.count_if(F.col("kind") == "normal").alias("commands"))


def image(state: DataFrame, sessions: DataFrame) -> DataFrame:
    """A fingerprint of a state machine: rows and order-independent sums over keys and sessions."""
    kv = state.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.bit_xor(F.xxhash64("key", "value")), F.lit(0)).alias("kv_hash"))
    se = sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(sessions.columns))), F.lit(0)).alias("session_hash"))
    return kv.join(F.broadcast(se))  # one row each
