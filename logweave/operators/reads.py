"""Reads at a consistency mode, as as-of reads gated by node state.

`nodes` has a row per node: node, role, leader (the leader it knows), term, commit, applied, last_index, lease_valid,
commit_term (the term of its entry at commit), read_confirmed (a quorum answered the read's round).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("stale", "lease", "linearizable")


def admit(nodes: DataFrame, mode: str) -> DataFrame:
    """nodes with the answer (serve, not_leader, not_ready or retry) and the index up to which the read sees the log."""
    if mode == "stale":
        return nodes.withColumn("answer", F.lit("serve")).withColumn("read_index", F.col("applied"))
    if mode == "lease":
        answer = F.when(F.col("role") != "leader", "not_leader").when(F.col("lease_valid"), "serve").otherwise("retry")
        return nodes.withColumn("answer", answer).withColumn("read_index", F.when(answer == "serve", F.col("applied")))
    if mode == "linearizable":
        ready = F.col("commit_term") == F.col("term")
        answer = F.when(F.col("role") != "leader", "not_leader").when(~ready, "not_ready").when(~F.col("read_confirmed") | (F.col("applied") < F.col("commit")), "retry").otherwise("serve")
        return nodes.withColumn("answer", answer).withColumn("read_index", F.when(answer == "serve", F.col("commit")))
    raise ValueError(f"mode must be one of {MODES}")


def read(log: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    """(node, key, value): the live rows that each node that serves the mode returns.

    The log is read once, whatever the number of nodes: a version belongs to the lowest read index that sees it, the
    newest of each key and index is kept by partial aggregation, and only these are looked at for every index."""
    served = admit(nodes, mode).where("answer = 'serve'").select("node", "read_index")
    indexes = served.agg(F.array_sort(F.collect_set("read_index")).alias("indexes"))  # at most one number per node
    seen = log.join(F.broadcast(indexes)).withColumn("upto", F.array_min(F.filter("indexes", lambda i: i >= F.col("seq")))).where("upto is not null")
    newest = seen.groupBy("key", "upto").agg(F.max_by(F.struct("seq", "value"), "seq").alias("last"))
    by_key = newest.groupBy("key").agg(F.collect_list(F.struct("upto", "last")).alias("found"))
    at = by_key.join(F.broadcast(indexes)).withColumn("read_index", F.explode("indexes"))
    last = F.array_max(F.transform(F.filter("found", lambda x: x["upto"] <= F.col("read_index")), lambda x: x["last"]))
    live = at.select("key", "read_index", last["value"].alias("value")).where("value is not null")
    return live.join(served, "read_index").select("node", "key", "value")


def read_key(log: DataFrame, nodes: DataFrame, mode: str, key: Any) -> DataFrame:
    """(node, answer, status, value) of one key at every node: the status is null where the node does not serve."""
    versions = log.where(F.col("key") == (key if isinstance(key, Column) else F.lit(key))).select("seq", "value")
    asked = admit(nodes, mode).select("node", "answer", "read_index")
    found = asked.join(versions, F.col("seq") <= F.col("read_index"), "left").groupBy("node", "answer").agg(F.max_by(F.struct("seq", "value"), "seq").alias("last"))
    status = F.when(F.col("answer") == "serve", F.when(F.col("last").isNull() | F.col("last.seq").isNull(), "missing").when(F.col("last.value").isNull(), "tombstone").otherwise("live"))
    return found.select("node", "answer", status.alias("status"), F.col("last.value").alias("value"))


def release(pending: DataFrame, applied: DataFrame) -> DataFrame:
    """pending (node, read_id, read_index) with whether the node's applied index allows it; the rest stays pending."""
    return pending.join(applied.select("node", "applied"), "node").withColumn("ready", F.col("read_index") <= F.col("applied")).drop("applied")


def expired(pending: DataFrame, now: int) -> DataFrame:
    """Pending operations (id, deadline) whose deadline has passed; they are answered with retry."""
    return pending.where(F.col("deadline") <= now).withColumn("answer", F.lit("retry"))


def status(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "role", "term", "leader", "commit", "applied", "last_index", "voters")


def proposal_errors(proposals: DataFrame) -> DataFrame:
    """proposals (role, leader, ready, is_conf, conf_in_flight) with what the client is told; null if accepted."""
    error = F.when(F.col("role") != "leader", F.concat(F.lit("not_leader:"), F.coalesce(F.col("leader").cast("string"), F.lit("none")))).when(~F.col("ready"), "retry").when(F.col("is_conf") & F.col("conf_in_flight"), "configuration change in flight")
    return proposals.withColumn("error", error)


def attempts(tries: DataFrame, max_attempts: int = 12) -> DataFrame:
    """tries (attempt, answer, hint) with the client's next step."""
    step = F.when(F.col("answer") == "ok", "done").when(F.col("answer") == "error", "fail").when(F.col("attempt") + 1 >= max_attempts, "give_up")
    step = step.when((F.col("answer") == "not_leader") & F.col("hint").isNotNull(), "jump_to_hint").when(F.col("answer") == "not_leader", "next_address").when(F.col("answer") == "retry", "same_node").otherwise("next_address")
    return tries.withColumn("step", step)
