"""Invariants over runs and histories: each returns its violations, so an empty result is a pass.

`linearizable` decides each key of a history by search; the others are aggregations.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave import schema


def election_safety(leaders: DataFrame) -> DataFrame:
    """leaders (term, leader): terms with more than one."""
    return leaders.groupBy("term").agg(F.count_distinct("leader").alias("leaders")).where("leaders > 1")


def state_machine_safety(applied: DataFrame) -> DataFrame:
    """applied (node, index, term, payload): indexes at which nodes applied different entries."""
    return applied.groupBy("index").agg(F.count_distinct(F.struct("term", "payload")).alias("entries")).where("entries > 1")


def log_matching(entries: DataFrame) -> DataFrame:
    """(index, term) with different payloads or kinds."""
    return entries.groupBy("index", "term").agg(F.count_distinct(F.struct("kind", "payload")).alias("entries")).where("entries > 1")


def convergence(nodes: DataFrame) -> DataFrame:
    """nodes (node, up, role, applied, fingerprint): one row with what the whole run's end must show."""
    one = nodes.agg(F.min("up").alias("all_up"), (F.count_distinct("applied") == 1).alias("same_applied"), (F.count_distinct("fingerprint") == 1).alias("same_state"), F.max(F.col("role") == "leader").alias("has_leader"))
    return one.withColumn("converged", F.col("all_up") & F.col("same_applied") & F.col("same_state") & F.col("has_leader"))


def log_fingerprints(entries: DataFrame, upto: int | None = None) -> DataFrame:
    """(node, last_index, fingerprint) of logs up to an index."""
    e = entries if upto is None else entries.where(F.col("index") <= upto)
    return e.groupBy("node").agg(F.max("index").alias("last_index"), F.bit_xor(F.xxhash64("index", "term", "payload")).alias("fingerprint"))


def logs_converged(entries: DataFrame) -> DataFrame:
    """One row: whether all logs end at the same index, and the number of indexes at which known terms differ."""
    ends = entries.groupBy("node").agg(F.max("index").alias("last")).agg((F.count_distinct("last") == 1).alias("same_end"))
    bad = entries.groupBy("index").agg(F.count_distinct("term").alias("t")).agg(F.count_if(F.col("t") > 1).alias("different_terms"))
    return ends.join(F.broadcast(bad))  # one row each


def overwritten_commits(entries: DataFrame, incoming: DataFrame, commits: DataFrame) -> DataFrame:
    """incoming (node, index, term) that differ from an entry at or below the node's commit index."""
    mine = entries.select("node", "index", F.col("term").alias("held"))
    return incoming.join(mine, ["node", "index"]).join(commits, "node").where("term != held and index <= commit").select("node", "index", "held", "term")


def over_budget(runs: DataFrame, budget: int = schema.EVENT_BUDGET) -> DataFrame:
    """runs (seed, events) that used up their events: livelock."""
    return runs.where(F.col("events") > budget)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two runs of one seed don't share, repeats counted; empty if the run is deterministic."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def duplicate_sessions(sessions: DataFrame) -> DataFrame:
    """sessions (client, session_id): ids that more than one client uses."""
    return sessions.groupBy("session_id").agg(F.count_distinct("client").alias("clients")).where("clients > 1")


def history_summary(history: DataFrame) -> DataFrame:
    """One row: operations, distinct keys, and operations that never returned."""
    return history.agg(F.count(F.lit(1)).alias("ops"), F.count_distinct("key").alias("keys"), F.count_if(F.col("ret").isNull()).alias("pending"))


def malformed(history: DataFrame) -> DataFrame:
    """Completed compare-and-swaps without an outcome, and unknown operations."""
    return history.where("(op = 'cas' and ret is not null and success is null) or op not in ('read', 'write', 'cas')")


def impossible_reads(history: DataFrame) -> DataFrame:
    """Reads of values that nothing wrote, or that were first written after the read had returned (extension)."""
    written = history.where("op = 'write'").select("key", F.col("value").alias("v"), "invoke").unionByName(history.where("op = 'cas' and new is not null").select("key", F.col("new").alias("v"), "invoke"))
    first = written.groupBy("key", "v").agg(F.min("invoke").alias("first"))
    reads = history.where("op = 'read' and ret is not null and value is not null").withColumn("v", F.col("value"))
    return reads.join(first, ["key", "v"], "left").where("first is null or first > ret").drop("v", "first")


def _after(op: dict[str, Any], value: Any) -> tuple[bool, Any]:
    """Whether an operation can take effect on a register with this value, and the value then."""
    if op["op"] == "read":
        return op["value"] == value, value
    if op["op"] == "write":
        return True, op["value"]
    hit = op["expect"] == value
    return op["success"] is None or op["success"] == hit, op["new"] if hit else value


def _windows(ops: list[dict[str, Any]]) -> list[tuple[int, list[int]]]:
    """For each return in time order: the operation, and those open then. Equal stamps are concurrent."""
    stamps = sorted([(o["invoke"], 0, i) for i, o in enumerate(ops)] + [(o["ret"], 1, i) for i, o in enumerate(ops) if o["ret"] is not None])
    live: dict[int, None] = {}
    out = []
    for _, returns, i in stamps:
        if returns:
            out.append((i, list(live)))
            live.pop(i, None)
        else:
            live[i] = None
    return out


def search(ops: list[dict[str, Any]], budget: int = schema.CHECKER_BUDGET) -> tuple[bool, str]:
    """Whether one register's operations have a total order that respects real time.

    Returns are passed one after the other: each needs its operation to have taken effect, maybe after others that are
    open at that time. A state is the next return, which open operations have taken effect, and the register's value
    (None: absent); so it is as small as the number of concurrent operations, however long the history. Pending writes
    and swaps may be left out. Operations have invoke, ret, op, value, expect, new and success."""
    ops = [o for o in ops if not (o["op"] == "read" and o["ret"] is None)]
    if len(ops) > schema.CHECKER_MAX_OPS:
        return False, f"too many operations: {len(ops)}"
    if any(o["ret"] is not None and o["ret"] < o["invoke"] for o in ops):
        return False, "returned before it was invoked"
    windows = _windows(ops)
    seen: set[tuple[int, frozenset[int], Any]] = set()
    todo: list[tuple[int, frozenset[int], Any]] = [(0, frozenset(), None)]
    while todo:
        state = todo.pop()
        place, done, value = state
        if place == len(windows):
            return True, ""
        if state in seen:
            continue
        if len(seen) == budget:
            return False, "budget exceeded"
        seen.add(state)
        due, live = windows[place]
        if due in done:
            todo.append((place + 1, done - {due}, value))
            continue
        ways = [(i, after) for i in live if i not in done for possible, after in (_after(ops[i], value),) if possible]
        # a completed operation that fits and changes nothing loses nothing by coming first
        free = next((i for i, after in ways if ops[i]["ret"] is not None and ops[i]["op"] != "write" and after == value), None)
        if free is not None:
            todo.append((place, done | {free}, value))
            continue
        # the one that has to return is tried first, so it is pushed last
        ways.sort(key=lambda way: way[0] == due)
        todo += [(place, done | {i}, after) for i, after in ways]
    return False, "not linearizable"


_VERDICT = pa.schema([("key", pa.int64()), ("ok", pa.bool_()), ("reason", pa.string())])


def linearizable(history: DataFrame, budget: int = schema.CHECKER_BUDGET) -> DataFrame:
    """(key, ok, reason) for each key of a history. A key beyond the operation cap gets its verdict from its count, so
    no task gathers more than the cap. Values and stamps stay 64-bit integers throughout."""
    sizes = history.where("not (op = 'read' and ret is null)").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > schema.CHECKER_MAX_OPS)
    bad = malformed(history).select("key").distinct()
    fit = history.join(large, "key", "left_anti").join(bad, "key", "left_anti")

    def run(table: pa.Table) -> pa.Table:
        ok, reason = search(table.to_pylist(), budget)
        return pa.Table.from_pydict({"key": [table["key"][0].as_py()], "ok": [ok], "reason": [reason]}, _VERDICT)

    found = fit.groupBy("key").applyInArrow(run, "key bigint, ok boolean, reason string")
    capped = large.join(bad, "key", "left_anti").select("key", F.lit(False).alias("ok"), F.concat(F.lit("too many operations: "), F.col("n").cast("string")).alias("reason"))
    return found.unionByName(capped).unionByName(bad.select("key", F.lit(False).alias("ok"), F.lit("malformed").alias("reason")))
