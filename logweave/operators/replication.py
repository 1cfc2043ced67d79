"""Computations over replication state: quorums, leases, read release, voter sets, log repair, snapshots, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import schema
from logweave.functions.order import kth_largest, quorum, running_sums

#: Log indexes of a run; runs spread one node's log over tasks.
RUN = 1 << 16


def quorum_value(reports: DataFrame, value: str, electorate: DataFrame) -> DataFrame:
    """(leader, q): what a quorum of each leader's voters has reached. `electorate` has a row (leader, peer) per voter;
    a voter without a report, or with a null one, counts as 0, and reports of others don't count."""
    latest = reports.groupBy("leader", "peer").agg(F.max(value).alias("v"))
    every = electorate.select("leader", "peer").distinct().join(latest, ["leader", "peer"], "left")
    g = every.groupBy("leader").agg(F.collect_list(F.coalesce("v", F.lit(0))).alias("v"))  # one number per voter
    return g.select("leader", kth_largest(F.col("v"), quorum(F.size("v"))).alias("q"))


def quorum_commit(leaders: DataFrame, progress: DataFrame, electorate: DataFrame, entries: DataFrame) -> DataFrame:
    """leaders (leader, term, commit) and progress (leader, peer, matched; the leader itself is a peer at its last index)
    to (leader, term, candidate, commit): the quorum's index, adopted only if it is greater and its entry is of the
    current term."""
    q = leaders.join(quorum_value(progress, "matched", electorate).withColumnRenamed("q", "candidate"), "leader")
    terms = entries.select(F.col("node").alias("leader"), F.col("index").alias("candidate"), F.col("term").alias("entry_term"))
    q = q.join(terms, ["leader", "candidate"], "left")
    better = (F.col("candidate") > F.col("commit")) & (F.col("entry_term") == F.col("term"))
    return q.select("leader", "term", "candidate", F.when(better, F.col("candidate")).otherwise(F.col("commit")).alias("commit"))


def lease(leaders: DataFrame, responses: DataFrame, electorate: DataFrame, tick_min: int = schema.ELECTION_TICK_MIN) -> DataFrame:
    """leaders (leader, now) and responses (leader, peer, tick; the leader's own tick is now) to (leader, quorum_tick,
    lease_valid)."""
    g = leaders.join(quorum_value(responses, "tick", electorate).withColumnRenamed("q", "quorum_tick"), "leader")
    return g.select("leader", "quorum_tick", (F.greatest(F.col("now") - F.col("quorum_tick"), F.lit(0)) < tick_min).alias("lease_valid"))


def released_reads(acks: DataFrame, pending: DataFrame, electorate: DataFrame) -> DataFrame:
    """acks (leader, peer, ctx) and pending (leader, read_id, ctx): the reads that a quorum's acknowledgements release."""
    g = quorum_value(acks, "ctx", electorate).withColumnRenamed("q", "upto")
    return pending.join(g, "leader").where("upto > 0 and ctx <= upto").select("leader", "read_id", "ctx")


def read_admission(nodes: DataFrame) -> DataFrame:
    """nodes (node, role, term, commit_term) with not_leader, not_ready or admitted."""
    return nodes.withColumn("admission", F.when(F.col("role") != "leader", "not_leader").when(F.col("commit_term").eqNullSafe(F.col("term")), "admitted").otherwise("not_ready"))


def voters(changes: DataFrame, base: list[int], upto: int | None = None) -> DataFrame:
    """changes (node, index, action, peer) to (node, voters): every change up to the index counts, committed or not.

    Adding twice changes nothing; order is that of joining. A log holds few membership changes."""
    c = changes if upto is None else changes.where(F.col("index") <= upto)
    g = c.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("index", "action", "peer"))).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["action"] == "remove", F.array_remove(acc, x["peer"])).when(F.array_contains(acc, x["peer"]), acc).otherwise(F.array_append(acc, x["peer"]))

    start = F.array(*[F.lit(v).cast("bigint") for v in base])
    return g.select("node", F.aggregate("c", start, step).alias("voters"))


def conf_in_flight(entries: DataFrame, commits: DataFrame) -> DataFrame:
    """(node, in_flight): whether a membership change lies above the node's commit index."""
    last = entries.where("kind = 'conf'").groupBy("node").agg(F.max("index").alias("last"))
    return commits.join(last, "node", "left").select("node", F.coalesce(F.col("last") > F.col("commit"), F.lit(False)).alias("in_flight"))


def up_to_date(term: Column, index: Column, my_term: Column, my_index: Column) -> Column:
    """Whether a log ending in (term, index) is at least as new as mine."""
    return (term > my_term) | ((term == my_term) & (index >= my_index))


def vote_decisions(requests: DataFrame) -> DataFrame:
    """requests (candidate, req_term, last_term, last_index, term, voted_for, my_last_term, my_last_index, leader_alive)
    with the answers to a pre-vote and to a vote."""
    newer = up_to_date(F.col("last_term"), F.col("last_index"), F.col("my_last_term"), F.col("my_last_index"))
    free = F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    # a higher term clears the vote
    free = free | (F.col("req_term") > F.col("term"))
    return requests.withColumn("pre_vote", (F.col("req_term") > F.col("term")) & newer & ~F.col("leader_alive")).withColumn("vote", (F.col("req_term") >= F.col("term")) & free & newer)


def elected(votes: DataFrame, electorate: DataFrame) -> DataFrame:
    """votes (candidate, voter, granted) of current voters: (candidate, granted, elected)."""
    size = electorate.agg(F.count(F.lit(1)).alias("n"))
    counted = votes.join(electorate, "voter", "left_semi").groupBy("candidate").agg(F.count_if("granted").alias("granted"))
    return counted.join(F.broadcast(size)).select("candidate", "granted", (F.col("granted") >= quorum(F.col("n"))).alias("elected"))  # one row


def repair(local: DataFrame, leader: DataFrame, commit: int = 0) -> DataFrame:
    """The follower's log (index, term, payload) after the leader's entries: kept up to the first difference of terms,
    replaced from there on. `violation` marks a committed entry that would be overwritten."""
    both = local.select("index", F.col("term").alias("t1")).join(leader.select("index", F.col("term").alias("t2")), "index")
    first = both.where("t1 != t2").agg(F.min("index").alias("conflict"))
    last = local.agg(F.max("index").alias("last"))
    mark = first.join(F.broadcast(last))  # one row each
    kept = local.select("index", "term", "payload").join(F.broadcast(mark)).where("conflict is null or index < conflict")
    added = leader.select("index", "term", "payload").join(F.broadcast(mark)).where("index >= coalesce(conflict, coalesce(last, 0) + 1)")
    out = kept.withColumn("source", F.lit("local")).unionByName(added.withColumn("source", F.lit("leader")))
    return out.select("index", "term", "payload", "source", F.coalesce(F.col("conflict") <= commit, F.lit(False)).alias("violation"))


def term_starts(entries: DataFrame) -> DataFrame:
    """entries (node, index, term) with `lo`, the first index of the unbroken run of that term. Runs of indexes are
    looked at first, so one node's log is spread over tasks."""
    e = entries.select("node", "index", "term", F.floor(F.col("index") / RUN).alias("run"))
    inner = Window.partitionBy("node", "run").orderBy("index")
    before = F.lag(F.struct("index", "term")).over(inner)
    ends = e.groupBy("node", "run").agg(F.max(F.struct("index", "term")).alias("end"))
    log = Window.partitionBy("node").orderBy("run")
    ends = ends.withColumn("carried", F.lag("end").over(log)).drop("end")
    e = e.withColumn("within", before).join(ends, ["node", "run"])
    previous = F.coalesce("within", "carried")
    goes_on = F.coalesce((previous["term"] == F.col("term")) & (previous["index"] == F.col("index") - 1), F.lit(False))
    e = e.withColumn("start", F.when(~goes_on, F.col("index"))).drop("within", "carried")
    firsts = e.groupBy("node", "run").agg(F.max("start").alias("s"))
    firsts = firsts.select("node", "run", F.max("s").over(log.rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
    e = e.withColumn("lo", F.max("start").over(inner)).join(firsts, ["node", "run"])
    return e.select("node", "index", "term", F.coalesce("lo", "ahead").alias("lo"))


def conflict_hint(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (node, prev_index, prev_term) with the hint: last + 1 if the log is too short, the first index of the
    conflicting run of terms, or null if the entry matches. A probe meets its entry by equality on (node, index)."""
    held = term_starts(entries).select("node", F.col("index").alias("prev_index"), "term", "lo")
    last = entries.groupBy("node").agg(F.max("index").alias("last"))
    p = probes.join(held, ["node", "prev_index"], "left").join(last, "node", "left")
    hint = F.when(F.col("prev_index") > F.coalesce("last", F.lit(0)), F.coalesce("last", F.lit(0)) + 1).when(F.col("term") != F.col("prev_term"), F.col("lo"))
    return p.select("node", "prev_index", "prev_term", hint.alias("hint"))


def uncovered(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Entries above their node's snapshot base; what a compaction leaves, and what a message past one still holds."""
    return entries.join(snapshots.select("node", "last_index"), "node", "left").where("last_index is null or index > last_index").drop("last_index")


def compaction_allowed(nodes: DataFrame) -> DataFrame:
    """nodes (node, snap, applied, commit) with whether the log may be compacted to the applied index."""
    return nodes.withColumn("allowed", (F.col("snap") < F.col("applied")) & (F.col("applied") <= F.col("commit")))


def snapshots(nodes: DataFrame, entries: DataFrame, changes: DataFrame, base: list[int]) -> DataFrame:
    """nodes (node, snap, applied, commit) whose log may be compacted, with the snapshot to take: (node, last_index,
    last_term, voters). The membership changes up to the applied index are folded into its voters."""
    allowed = compaction_allowed(nodes).where("allowed").select("node", "applied")
    folded = voters(changes.join(allowed, "node").where("index <= applied").select("node", "index", "action", "peer"), base)
    start = F.array(*[F.lit(v).cast("bigint") for v in base])
    terms = entries.select("node", F.col("index").alias("applied"), F.col("term").alias("last_term"))
    out = allowed.join(terms, ["node", "applied"]).join(folded, "node", "left")
    return out.select("node", F.col("applied").alias("last_index"), "last_term", F.coalesce("voters", start).alias("voters"))


def after_offers(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """What is left of each node's log after its snapshot offers (of `snapshot_decisions`): all of it, or nothing if
    one resets it."""
    return entries.join(decisions.where("decision = 'reset'").select("node").distinct(), "node", "left_anti")


def follower_commit(messages: DataFrame) -> DataFrame:
    """messages (commit, leader_commit, prev_index, n_entries) with the commit index that they lead to."""
    return messages.withColumn("new_commit", F.greatest("commit", F.least("leader_commit", F.col("prev_index") + F.col("n_entries"))))


def committed_between(entries: DataFrame, old: int, new: int) -> DataFrame:
    """Entries to emit, in order: (old, new]."""
    return entries.where((F.col("index") > old) & (F.col("index") <= new)).orderBy("index")


def snapshot_decisions(offers: DataFrame, entries: DataFrame) -> DataFrame:
    """offers (node, commit, last_index, last_term) with stale, keep_suffix (the entry is held: only the commit index
    moves) or reset."""
    held = entries.select("node", F.col("index").alias("last_index"), F.col("term").alias("held_term"))
    decision = F.when(F.col("last_index") <= F.col("commit"), "stale").when(F.col("held_term").eqNullSafe(F.col("last_term")), "keep_suffix").otherwise("reset")
    return offers.join(held, ["node", "last_index"], "left").select("node", "commit", "last_index", "last_term", decision.alias("decision"))


def accessors(entries: DataFrame) -> DataFrame:
    """(node, first_index, last_index, last_term, entries) of each log."""
    return entries.groupBy("node").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.max_by("term", "index").alias("last_term"), F.count(F.lit(1)).alias("entries"))


def gaps(entries: DataFrame) -> DataFrame:
    """Violations of contiguity: entries whose index isn't one above the one before."""
    e = entries.select("node", "index", F.floor(F.col("index") / RUN).alias("run"))
    ends = e.groupBy("node", "run").agg(F.max("index").alias("end"))
    ends = ends.withColumn("carried", F.lag("end").over(Window.partitionBy("node").orderBy("run"))).drop("end")
    inner = F.lag("index").over(Window.partitionBy("node", "run").orderBy("index"))
    before = F.coalesce("inner", "carried")
    joined = e.withColumn("inner", inner).join(ends, ["node", "run"]).withColumn("before", before)
    return joined.where("before is not null and index != before + 1").select("node", "index", "before")


def progress_from_acks(acks: DataFrame) -> DataFrame:
    """acks (peer, kind, match_index) to (peer, matched, next): snapshot transfers count like appends."""
    return acks.groupBy("peer").agg(F.max("match_index").alias("matched")).withColumn("next", F.col("matched") + 1)


def progress_after(events: DataFrame, last_index: int) -> DataFrame:
    """Each peer's progress after its events, from one with nothing matched and next 1: (peer, matched, next, inflight,
    pending_snapshot). Events are (peer, step, kind, index, n):

    - `sent`: n entries go out; next rises by n, and a slot of the window is taken;
    - `ok` at index: matched and next rise to it, and a slot is freed;
    - `reject` with the conflict index (above 0): next is set to it, clamped to the log, and the window is empty;
    - `snapshot`: a transfer begins; `installed` at index ends it: matched and next rise, and the window is empty.

    next is the greatest of what each event sets it to plus what was sent after; the window, which never falls below
    0, is its sum less the lowest that the sum was. So both come from running sums and partial aggregates, and one
    peer's events are spread over tasks."""
    kind, index = F.col("kind"), F.col("index")
    sums = {"sent": F.when(kind == "sent", F.col("n")), "taken": F.when(kind == "sent", 1).when(kind == "ok", -1)}
    rows = running_sums(events, ["peer"], "step", sums)
    rejected, installed = (kind == "reject") & (index > 0), kind == "installed"
    last = events.groupBy("peer").agg(F.max(F.when(rejected, F.col("step"))).alias("set_at"), F.max(F.when(rejected | installed, F.col("step"))).alias("empty_at")).withColumnRenamed("peer", "of")
    rows = rows.join(last, F.col("peer").eqNullSafe(F.col("of")))
    clamped = F.greatest(F.lit(1), F.least(index, F.lit(last_index + 1)))
    reached = F.when(rejected, clamped).when(kind.isin("ok", "installed"), index + 1)
    since_set = F.col("set_at").isNull() | (F.col("step") >= F.col("set_at"))
    since_empty = F.col("empty_at").isNull() | (F.col("step") >= F.col("empty_at"))
    g = rows.groupBy("peer").agg(
        F.coalesce(F.max(F.when(kind.isin("ok", "installed"), index)), F.lit(0)).alias("matched"),
        F.max(F.when(since_set, reached - F.col("sent"))).alias("reached"),
        F.max("set_at").alias("set_at"), F.max("empty_at").alias("empty_at"), F.max("sent").alias("all_sent"), F.min(F.when(since_empty, F.col("taken"))).alias("lowest"),
        F.max(F.struct("step", "taken"))["taken"].alias("all_taken"), F.max(F.struct(kind.isin("snapshot", "installed"), "step", kind == "snapshot")).alias("transfer"),
    )
    nothing = F.when(F.col("set_at").isNull(), F.lit(1))
    lowest = F.least("lowest", F.when(F.col("empty_at").isNull(), F.lit(0)))
    pending = F.col("transfer.col1") & F.col("transfer.col3")
    return g.select("peer", "matched", (F.greatest("reached", nothing) + F.col("all_sent")).alias("next"), (F.col("all_taken") - lowest).cast("bigint").alias("inflight"), pending.alias("pending_snapshot"))


def replies(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """messages (id, node, prev_index, prev_term, n_entries) with the follower's reply: success, the index up to which
    the logs now match (0 on a rejection), and the conflict index (0 on success)."""
    hinted = conflict_hint(entries, messages.select("node", "prev_index", "prev_term").distinct())
    back = messages.join(hinted, ["node", "prev_index", "prev_term"])
    ok = F.col("hint").isNull()
    return back.select("id", "node", ok.alias("success"), F.when(ok, F.col("prev_index") + F.col("n_entries")).otherwise(0).alias("match_index"), F.coalesce("hint", F.lit(0)).alias("conflict_index"))


def empty_outputs(outputs: DataFrame, parts: list[str]) -> DataFrame:
    """outputs with whether there is nothing to do: each part is null, false or an empty array."""
    kinds = dict(outputs.dtypes)
    nothing = [F.coalesce(F.size(p) <= 0, F.lit(True)) if kinds[p].startswith("array") else F.coalesce(~F.col(p), F.lit(True)) if kinds[p] == "boolean" else F.col(p).isNull() for p in parts]
    out = F.lit(True)
    for x in nothing:
        out &= x
    return outputs.withColumn("empty", out)


def sendable(messages: DataFrame, durable: DataFrame) -> DataFrame:
    """messages (node, id, last_index) with whether they may go out: what they carry is durable on their node first.
    `durable` has (node, durable_index); without a row nothing is."""
    d = durable.groupBy("node").agg(F.max("durable_index").alias("durable_index"))
    return messages.join(d, "node", "left").withColumn("send", F.col("last_index") <= F.coalesce("durable_index", F.lit(0))).drop("durable_index")


def step_downs(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """commits (node, role, old, new) with whether a leader steps down: its own removal lies in (old, new] of its log
    (changes (node, index, action, peer))."""
    own = changes.where("action = 'remove' and peer = node").select("node", "index")
    hit = commits.join(own, "node").where("index > old and index <= new").groupBy("node", "old", "new").agg(F.lit(True).alias("gone"))
    return commits.join(hit, ["node", "old", "new"], "left").select("node", "role", "old", "new", ((F.col("role") == "leader") & F.coalesce("gone", F.lit(False))).alias("steps_down"))


def send_decisions(progress: DataFrame, tick_min: int = schema.ELECTION_TICK_MIN) -> DataFrame:
    """progress (next, inflight, pending_snapshot, silent_ticks, snap_index, last_index) with what the leader sends and
    how many entries; a pending snapshot is retried after tick_min silent ticks, a full window still gets heartbeats."""
    waiting = F.col("pending_snapshot") & (F.col("silent_ticks") < tick_min)
    behind, has = F.col("next") <= F.col("snap_index"), F.col("next") <= F.col("last_index")
    full = F.col("inflight") >= schema.MAX_INFLIGHT
    send = F.when(waiting, "suppressed").when(behind, "snapshot").when(has & ~full, "append").otherwise("heartbeat")
    n = F.when(send == "append", F.least(F.lit(schema.MAX_BATCH_ENTRIES), F.col("last_index") - F.col("next") + 1)).otherwise(0)
    slots = F.when((send == "heartbeat") & has & full, F.greatest(F.col("inflight") - 1, F.lit(0))).when(send == "append", F.col("inflight") + 1).otherwise(F.col("inflight"))
    return progress.withColumn("send", send).withColumn("n_entries", n.cast("bigint")).withColumn("new_inflight", slots)


def recovered(nodes: DataFrame, initial: list[int]) -> DataFrame:
    """nodes (node, term, voted_for, snap_index, snap_voters) as after a restart: a follower at its snapshot's commit."""
    start = F.array(*[F.lit(v).cast("bigint") for v in initial])
    return nodes.select("node", "term", "voted_for", F.lit("follower").alias("role"), F.coalesce("snap_index", F.lit(0)).alias("commit"), F.coalesce("snap_voters", start).alias("voters"))


def hard_state_changes(history: DataFrame) -> DataFrame:
    """history (node, step, term, voted_for): the steps at which term or vote really changed. A run of steps starts
    from the last state of the run before, so a node's history is spread over tasks."""
    h = history.withColumn("run", F.floor(F.col("step") / RUN)).withColumn("state", F.struct("term", "voted_for"))
    ends = h.groupBy("node", "run").agg(F.max_by("state", "step").alias("end"))
    ends = ends.withColumn("carried", F.lag("end").over(Window.partitionBy("node").orderBy("run"))).drop("end")
    within = F.lag("state").over(Window.partitionBy("node", "run").orderBy("step"))
    before = F.coalesce("within", "carried")
    return h.withColumn("within", within).join(ends, ["node", "run"]).where(before.isNull() | ~F.col("state").eqNullSafe(before)).select("node", "step", "term", "voted_for")


def persisted(stored: DataFrame, first_new: int, new: DataFrame) -> DataFrame:
    """A stored log after one batch: everything from the first new index on is replaced."""
    return stored.where(F.col("index") < first_new).unionByName(new)
