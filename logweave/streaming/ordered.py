"""Streams that come late, twice or out of order, and operations that time out.

`in_order` holds a session's commands back until the watermark of log indexes has passed them, drops repeated
deliveries and then decides them in log order; `deadlines` fires a timer for each operation that does not end in time.
Both keep only what is still open in the state, and both depend on event time alone, so a restart from the checkpoint
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.streaming.apply import STATUS_SCHEMA

#: The last applied number, if there is one, and the commands held back.
_STATE = "last bigint, known boolean, indexes array<bigint>, seqs array<bigint>"


def _event_time(number: str) -> Column:
    """A log index or a tick as event time: a second each, from 1 on, as a watermark of 0 lets nothing at 0 pass."""
    return F.timestamp_seconds(F.col(number) + 1)


_COLUMNS = [x.split()[0] for x in STATUS_SCHEMA.split(", ")]


def _held(state: GroupState) -> tuple[int | None, dict[int, int]]:
    if not state.exists:
        return None, {}
    last, known, indexes, seqs = state.get
    return (int(last) if known else None), dict(zip(map(int, indexes), map(int, seqs)))


def _release(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    session, (last, held) = key[0], _held(state)
    if not state.hasTimedOut:
        for pdf in batches:
            for i, seq in zip(pdf["log_index"].tolist(), pdf["client_seq"].tolist()):
                held.setdefault(i, seq)  # a repeated delivery is the same command
    passed = state.getCurrentWatermarkMs() // 1000 - 1
    out = []
    for i in sorted(x for x in held if x <= passed):
        seq = held.pop(i)
        if session == 0 or last is None or seq > last:
            status, last = "applied", seq
        else:
            status = "duplicate" if seq == last else "stale"
        out.append((i, session, seq, status))
    state.update((last if last is not None else 0, last is not None, sorted(held), [held[i] for i in sorted(held)]))
    if held:
        state.setTimeoutTimestamp(max((min(held) + 1) * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=_COLUMNS)


def in_order(commands: DataFrame, lag: int) -> DataFrame:
    """A stream of commands (log_index, session_id, client_seq), delivered at least once and up to `lag` indexes out of
    order, to one of statuses, each command once.

    A command is decided when the largest index seen is `lag` beyond it; what is delivered later than that is dropped,
    as it can only be a repetition. The last `lag` indexes of a stream that has ended stay held back."""
    timed = commands.select("log_index", "session_id", "client_seq", _event_time("log_index").alias("at")).withWatermark("at", f"{lag} seconds")
    return timed.groupBy("session_id").applyInPandasWithState(_release, STATUS_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


_ANSWERS = "id bigint, answer string, tick bigint"


def _expire(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    out: list[tuple[int, str, int]] = []
    if state.hasTimedOut:
        (deadline,) = state.get
        state.remove()
        out = [(key[0], "retry", int(deadline))]
    else:
        rows = pd.concat(list(batches)).sort_values("tick", kind="stable")
        begun, ended = rows[rows["kind"] == "begin"], rows[rows["kind"] == "end"]
        deadline = int(state.get[0]) if state.exists else int(begun["deadline"].iloc[0]) if len(begun) else None
        if deadline is not None:
            if len(ended) and int(ended["tick"].iloc[0]) < deadline:
                out = [(key[0], "ok", int(ended["tick"].iloc[0]))]
                if state.exists:
                    state.remove()
            elif (deadline + 1) * 1000 <= state.getCurrentWatermarkMs():
                out = [(key[0], "retry", deadline)]
                if state.exists:
                    state.remove()
            else:
                state.update((deadline,))
                state.setTimeoutTimestamp((deadline + 1) * 1000)
    yield pd.DataFrame(out, columns=["id", "answer", "tick"])


def deadlines(operations: DataFrame, patience: int, lag: int = 0) -> DataFrame:
    """A stream of operations (id, kind: begin or end, tick) to one answer each: `ok` at its end, or `retry` at its
    deadline, `patience` ticks after its begin, if it has not ended before. Ticks may come up to `lag` out of order."""
    timed = operations.withColumn("deadline", F.col("tick") + patience).withColumn("at", _event_time("tick")).withWatermark("at", f"{lag} seconds")
    return timed.groupBy("id").applyInPandasWithState(_expire, _ANSWERS, "deadline bigint", "append", GroupStateTimeout.EventTimeTimeout)
