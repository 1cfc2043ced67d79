"""Registered queries of replication analytics and invariant checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import checks, replication
from logweave.plans.cmd import NODES_SQL, nodes
from logweave.sources import fixtures


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.replicas(spark, sf_dir)


def _one(spark: SparkSession, sf_dir: str, node: int) -> DataFrame:
    return _logs(spark, sf_dir).where(F.col("node") == node)


#: Voters of the leaders: five each, peers 0 to 4; what others report does not count.
def _electorate(spark: SparkSession, leaders: int) -> DataFrame:
    return spark.range(leaders * 5).select(F.floor(F.col("id") / 5).alias("leader"), (F.col("id") % 5).alias("peer"))


#: Progress of three leaders' peers, from events: the user number gives leader and peer. Peer 5 is no voter; leader 1
#: has two peers that never answered (one null, one absent), leader 2 three.
def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.events(spark, sf_dir)
    leader, peer = F.col("user_id") % 3, F.col("user_id") % 18 % 6
    peers = e.groupBy(leader.alias("leader"), peer.alias("peer")).agg((F.max("event_id") - F.min("event_id") % 400).alias("matched"))
    return peers.where("not (leader >= 1 and peer = 4)").withColumn("matched", F.when(~((F.col("leader") == 1) & (F.col("peer") == 1) | (F.col("leader") == 2) & (F.col("peer") <= 2)), F.col("matched")))


def _leaders(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("leader"), F.lit(9).cast("bigint").alias("term"), F.lit(500).cast("bigint").alias("commit"))


_VOTERS = "electorate AS (SELECT l.range AS leader, p.range AS peer FROM range({n}) l, range(5) p)"
_PROGRESS = f"""progress AS (SELECT user_id % 3 AS leader, user_id % 18 % 6 AS peer, max(event_id) - min(event_id) % 400 AS matched FROM events GROUP BY ALL),
  {_VOTERS.format(n=3)}, known AS (SELECT e.leader, e.peer, CASE WHEN (e.leader >= 1 AND e.peer = 4) OR (e.leader = 1 AND e.peer = 1) OR (e.leader = 2 AND e.peer <= 2) THEN 0 ELSE coalesce(p.matched, 0) END AS matched
    FROM electorate e LEFT JOIN progress p ON p.leader = e.leader AND p.peer = e.peer)"""


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the peers' last answers; those of leader 6's peers 1 to 3 are unknown."""
    e = fixtures.events(spark, sf_dir)
    ticks = e.groupBy((F.col("user_id") % 7).alias("leader"), (F.col("user_id") % 35 % 5).alias("peer")).agg((100 - F.max("event_id") % 23).alias("tick"))
    return ticks.withColumn("tick", F.when(~((F.col("leader") == 6) & F.col("peer").between(1, 3)), F.col("tick")))


_TICKS = f"""ticks AS (SELECT user_id % 7 AS leader, user_id % 35 % 5 AS peer, 100 - max(event_id) % 23 AS tick FROM events GROUP BY ALL),
  {_VOTERS.format(n=7)}, heard AS (SELECT e.leader, CASE WHEN e.leader = 6 AND e.peer BETWEEN 1 AND 3 THEN 0 ELSE coalesce(t.tick, 0) END AS tick FROM electorate e LEFT JOIN ticks t ON t.leader = e.leader AND t.peer = e.peer)"""

CHANGES = [(1, 5, "add", 4), (1, 9, "remove", 2), (1, 12, "add", 2), (1, 15, "add", 4), (2, 5, "add", 4), (2, 20, "remove", 1), (3, 7, "remove", 3), (3, 8, "remove", 9)]
_CHANGES = ", ".join(f"(CAST({a} AS BIGINT), CAST({b} AS BIGINT), '{c}', CAST({d} AS BIGINT))" for a, b, c, d in CHANGES)


def _changes(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_CHANGES} AS t(node, index, action, peer)")


def _commits(spark: SparkSession, base: int = 0) -> DataFrame:
    return nodes(spark).where("node <= 3").select("node", (F.col("commit") + base).alias("commit"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).select(
        i.alias("id"), (i % 5).alias("candidate"), (i % 4 + 3).alias("req_term"), (i % 3 + 2).alias("last_term"), (i % 17).alias("last_index"), F.lit(5).cast("bigint").alias("term"),
        F.when(i % 2 == 0, i % 6).alias("voted_for"), F.lit(3).cast("bigint").alias("my_last_term"), F.lit(8).cast("bigint").alias("my_last_index"), (i % 7 == 0).alias("leader_alive"),
    )


def _sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).select(i.alias("id"), (i % 300 + 1).alias("next"), (i % 13).alias("inflight"), (i % 6 == 0).alias("pending_snapshot"), (i % 21).alias("silent_ticks"), F.lit(40).cast("bigint").alias("snap_index"), F.lit(250).cast("bigint").alias("last_index"))


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).select((i % 3 + 1).alias("node"), F.lit(3000).cast("bigint").alias("commit"), (i + 1).alias("last_index"), F.floor((i + 1) / 1000 + 1 - (i % 20) / 20).alias("last_term"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).select(F.col("user_id").alias("node"), i.alias("step"), F.floor(i / 100).alias("term"), F.when(i % 3 != 0, F.floor(i / 150) % 4).alias("voted_for"))


def _progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five peers' leader sends and hears, in turns of eleven events."""
    i, turn = F.col("event_id"), F.col("event_id") % 11
    kind = F.when(turn < 5, "sent").when(turn < 9, "ok").when(turn == 9, "reject").when(F.floor(i / 11) % 2 == 0, "snapshot").otherwise("installed")
    index = F.when(turn < 5, 0).when(turn < 9, i % 700).when(turn == 9, F.when(i % 2 == 1, i % 300).otherwise(0)).otherwise(i % 500)
    return fixtures.events(spark, sf_dir).select((F.col("user_id") % 5).alias("peer"), i.alias("step"), kind.alias("kind"), index.alias("index"), F.when(turn < 5, i % 64 + 1).otherwise(0).alias("n"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).select(i.alias("id"), (i % 3 + 1).alias("node"), (i + 1).alias("prev_index"), (F.floor((i + 1) / 1000) + 1 + F.when(i % 13 == 0, 1).otherwise(0)).alias("prev_term"), (i % 9).alias("n_entries"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).select(i.alias("id"), F.when(i % 2 == 0, i).alias("hard_state"), F.sequence(F.lit(1), (i % 3).cast("int")).alias("committed"), (i % 5 == 0).alias("snapshot"))


def _commit_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).select((i % 3 + 1).alias("node"), F.when(i % 2 == 0, "leader").otherwise("follower").alias("role"), i.alias("old"), (i + 4).alias("new"))


#: Changes in which two leaders remove themselves.
_OWN = "SELECT * FROM VALUES (1L, 9L, 'remove', 2L), (1L, 60L, 'remove', 1L), (2L, 33L, 'remove', 2L), (3L, 5L, 'add', 3L) AS t(node, index, action, peer)"


QUERIES = {
    # RP1-RP5
    "quorum_commit": lambda s, d: replication.quorum_commit(_leaders(s, 3), _progress(s, d), _electorate(s, 3), _logs(s, d).where("node = 1").withColumn("node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))).withColumn("term", F.floor(F.col("index") / 1000))),
    "lease_valid": lambda s, d: replication.lease(_leaders(s, 7).withColumn("now", F.lit(100).cast("bigint")), _ticks(s, d), _electorate(s, 7)),
    "read_quorum_release": lambda s, d: replication.released_reads(_ticks(s, d).select("leader", "peer", F.col("tick").alias("ctx")), fixtures.events(s, d).select((F.col("user_id") % 7).alias("leader"), F.col("event_id").alias("read_id"), (F.col("event_id") % 120).alias("ctx")), _electorate(s, 7)),
    "read_index_admission": lambda s, d: replication.read_admission(nodes(s)).select("node", "admission"),
    # RP6, RP7
    "voters_effective": lambda s, d: replication.voters(_changes(s), [1, 2, 3], 14).select("node", F.array_join("voters", ",").alias("voters")),
    "conf_in_flight": lambda s, d: replication.conf_in_flight(_logs(s, d), _commits(s, 4650)),
    # RP8, RP9, RP22, RP23
    "vote_decisions": lambda s, d: replication.vote_decisions(_requests(s, d)).select("id", "pre_vote", "vote"),
    "vote_counting": lambda s, d: replication.elected(fixtures.events(s, d).select((F.col("event_id") % 50).alias("candidate"), F.floor(F.col("event_id") / 50).alias("voter"), (F.col("event_type") != "error").alias("granted")), s.range(5).select(F.col("id").alias("voter"))),
    # RP10-RP14
    "log_repair": lambda s, d: replication.repair(_one(s, d, 3), _one(s, d, 1), 9900),
    "conflict_hint": lambda s, d: replication.conflict_hint(_logs(s, d), fixtures.events(s, d).select((F.col("event_id") % 3 + 1).alias("node"), (F.col("event_id") + 1).alias("prev_index"), F.floor((F.col("event_id") + 1) / 1000 + 1).alias("prev_term"))),
    "log_compacted": lambda s, d: replication.uncovered(_logs(s, d), s.sql("SELECT * FROM VALUES (1L, 3000L), (2L, 9000L) AS t(node, last_index)")),
    "log_compaction_allowed": lambda s, d: replication.compaction_allowed(nodes(s).withColumn("snap", F.lit(4500))).select("node", "allowed"),
    "follower_commit": lambda s, d: replication.follower_commit(fixtures.events(s, d).select(F.col("event_id").alias("id"), (F.col("event_id") % 90).alias("commit"), (F.col("event_id") % 100).alias("leader_commit"), (F.col("event_id") % 80).alias("prev_index"), (F.col("event_id") % 9).alias("n_entries"))).select("id", "new_commit"),
    "committed_entries": lambda s, d: replication.committed_between(_one(s, d, 2), 400, 900),
    # RP15, RP17-RP20, RP28
    "snapshot_install": lambda s, d: replication.snapshot_decisions(_offers(s, d), _logs(s, d)),
    "log_accessors": lambda s, d: replication.accessors(_logs(s, d)),
    "log_gaps": lambda s, d: replication.gaps(_logs(s, d).where("index % 1000 != 7")),
    # RP14, RP16, RP18, RP19, RP27, RP28, RP31
    "step_downs": lambda s, d: replication.step_downs(_commit_moves(s, d), s.sql(_OWN)),
    "snapshots_taken": lambda s, d: replication.snapshots(_logs(s, d).groupBy("node").agg((F.max("index") - 30).alias("commit")).select("node", F.lit(8).cast("bigint").alias("snap"), F.when(F.col("node") == 2, 7).otherwise(F.col("commit") - 5).alias("applied"), "commit"), _logs(s, d), _changes(s), [1, 2, 3]).select("node", "last_index", "last_term", F.array_join("voters", ",").alias("voters")),
    "log_after_offers": lambda s, d: replication.after_offers(_logs(s, d), replication.snapshot_decisions(_offers(s, d).where("node = 2 or last_index = 12"), _logs(s, d))).groupBy("node").agg(F.count(F.lit(1)).alias("entries")),
    "progress_window": lambda s, d: replication.progress_after(_progress_events(s, d), 400),
    "send_gate": lambda s, d: replication.sendable(_messages(s, d).select("node", "id", F.col("prev_index").alias("last_index")), s.sql("SELECT * FROM VALUES (1L, 400L), (1L, 700L), (2L, 90L) AS t(node, durable_index)")).select("id", "send"),
    "append_replies": lambda s, d: replication.replies(_logs(s, d), _messages(s, d)),
    "output_emptiness": lambda s, d: replication.empty_outputs(_outputs(s, d).withColumn("committed", F.when(F.col("id") % 3 != 0, F.col("committed"))), ["hard_state", "committed", "snapshot"]).select("id", "empty"),
    "progress_from_acks": lambda s, d: replication.progress_from_acks(fixtures.events(s, d).select((F.col("user_id") % 5).alias("peer"), F.col("event_type").alias("kind"), F.col("event_id").alias("match_index"))),
    "send_decision": lambda s, d: replication.send_decisions(_sends(s, d)).select("id", "send", "n_entries", "new_inflight"),
    # RP29, RP30, SC24, SC25
    "node_recovery": lambda s, d: replication.recovered(nodes(s).select("node", "term", F.lit(None).cast("bigint").alias("voted_for"), F.when(F.col("node") != 2, F.col("applied")).alias("snap_index"), F.when(F.col("node") == 1, F.array(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("snap_voters")), [1, 2, 3]).select("node", "term", "role", "commit", F.array_join("voters", ",").alias("voters")),
    "hard_state_changes": lambda s, d: replication.hard_state_changes(_states(s, d)),
    "log_persisted": lambda s, d: replication.persisted(_one(s, d, 3), 9800, _one(s, d, 1).where("index >= 9800")),
    # CK1-CK5, CK12
    "election_safety": lambda s, d: checks.election_safety(fixtures.events(s, d).select(F.floor(F.col("event_id") / 60).alias("term"), F.when(F.col("event_id") % 480 < 430, 0).otherwise(F.col("user_id") % 2).alias("leader"))),
    "state_machine_safety": lambda s, d: checks.state_machine_safety(_logs(s, d)),
    "log_matching": lambda s, d: checks.log_matching(_logs(s, d).withColumn("payload", F.when((F.col("node") == 2) & (F.col("index") % 100 == 0), "changed").otherwise(F.col("payload")))),
    "convergence": lambda s, d: checks.convergence(checks.log_fingerprints(_logs(s, d)).select("node", F.lit(True).alias("up"), F.when(F.col("node") == 1, "leader").otherwise("follower").alias("role"), F.col("last_index").alias("applied"), "fingerprint")),
    "logs_converged": lambda s, d: checks.logs_converged(_logs(s, d)),
    "overwritten_commits": lambda s, d: checks.overwritten_commits(_one(s, d, 3), _one(s, d, 1).withColumn("node", F.lit(3).cast("bigint")), _commits(s, 5900)),
    # CK10, CK11
    "event_budget": lambda s, d: checks.over_budget(fixtures.events(s, d).groupBy(F.col("user_id").alias("seed")).agg(F.count(F.lit(1)).alias("events")), 70),
    "determinism": lambda s, d: checks.differences(fixtures.events(s, d).select("event_id", "event_type"), fixtures.events(s, d).select("event_id", F.when(F.col("event_id") % 1000 == 1, "x").otherwise(F.col("event_type")).alias("event_type"))),
    # CL5
    "session_uniqueness": lambda s, d: checks.duplicate_sessions(fixtures.events(s, d).select(F.col("event_id").alias("client"), (F.col("event_id") * 2 + F.when(F.col("event_id") % 900 == 5, 2).otherwise(0)).alias("session_id"))),
}

_Q = "list_reverse_sort(list({c}))[len(list({c})) // 2 + 1]"
ORACLE_SQL = {
    "quorum_commit": f"""WITH {_PROGRESS}, {fixtures.REPLICAS}, q AS (SELECT leader, 9::BIGINT AS term, 500::BIGINT AS commit, {_Q.format(c='matched')} AS candidate FROM known GROUP BY leader),
  e AS (SELECT index, index // 1000 AS term FROM replicas WHERE node = 1)
  SELECT q.leader, q.term, q.candidate, CASE WHEN q.candidate > q.commit AND e.term = q.term THEN q.candidate ELSE q.commit END AS commit FROM q LEFT JOIN e ON e.index = q.candidate""",
    "lease_valid": f"WITH {_TICKS}, q AS (SELECT leader, {_Q.format(c='tick')} AS quorum_tick FROM heard GROUP BY leader) SELECT leader, quorum_tick, greatest(100 - quorum_tick, 0) < 10 AS lease_valid FROM q",
    "read_quorum_release": f"WITH {_TICKS}, q AS (SELECT leader, {_Q.format(c='tick')} AS upto FROM heard GROUP BY leader) SELECT q.leader, e.event_id AS read_id, e.event_id % 120 AS ctx FROM events e JOIN q ON q.leader = e.user_id % 7 WHERE upto > 0 AND e.event_id % 120 <= upto",
    "read_index_admission": f"WITH {NODES_SQL} SELECT node, CASE WHEN role <> 'leader' THEN 'not_leader' WHEN commit_term = term THEN 'admitted' ELSE 'not_ready' END AS admission FROM nodes",
    "voters_effective": "SELECT * FROM (VALUES (1::BIGINT, '1,3,4,2'), (2, '1,2,3,4'), (3, '1,2')) t(node, voters)",
    "conf_in_flight": f"WITH {NODES_SQL}, {fixtures.REPLICAS}, c AS (SELECT node, commit + 4650 AS commit FROM nodes WHERE node <= 3) SELECT node, EXISTS (SELECT 1 FROM replicas r WHERE r.node = c.node AND r.kind = 'conf' AND r.index > c.commit) AS in_flight FROM c",
    "vote_decisions": """WITH r AS (SELECT event_id AS id, event_id % 5 AS candidate, event_id % 4 + 3 AS rt, event_id % 3 + 2 AS lt, event_id % 17 AS li, CASE WHEN event_id % 2 = 0 THEN event_id % 6 END AS v, event_id % 7 = 0 AS alive FROM events),
  n AS (SELECT *, lt > 3 OR (lt = 3 AND li >= 8) AS newer FROM r)
  SELECT id, rt > 5 AND newer AND NOT alive AS pre_vote, rt >= 5 AND (v IS NULL OR v = candidate OR rt > 5) AND newer AS vote FROM n""",
    "vote_counting": "SELECT event_id % 50 AS candidate, count(*) FILTER (event_type <> 'error') AS granted, count(*) FILTER (event_type <> 'error') >= 3 AS elected FROM events WHERE event_id // 50 < 5 GROUP BY 1",
    "log_repair": f"""WITH {fixtures.REPLICAS}, a AS (SELECT * FROM replicas WHERE node = 3), b AS (SELECT * FROM replicas WHERE node = 1),
  m AS (SELECT (SELECT min(a.index) FROM a JOIN b ON a.index = b.index AND a.term <> b.term) AS c, (SELECT max(index) FROM a) AS last)
  SELECT index, term, payload, 'local' AS source, coalesce(c <= 9900, false) AS violation FROM a, m WHERE c IS NULL OR index < c
  UNION ALL SELECT index, term, payload, 'leader', coalesce(c <= 9900, false) FROM b, m WHERE index >= coalesce(c, last + 1)""",
    "conflict_hint": f"""WITH {fixtures.REPLICAS}, r AS (SELECT *, index - row_number() OVER (PARTITION BY node, term ORDER BY index) AS island FROM replicas),
  runs AS (SELECT node, term, min(index) AS lo, max(index) AS hi FROM r GROUP BY node, term, island), ends AS (SELECT node, max(index) AS last FROM replicas GROUP BY node),
  p AS (SELECT event_id % 3 + 1 AS node, event_id + 1 AS prev_index, (event_id + 1) // 1000 + 1 AS prev_term FROM events)
  SELECT p.*, CASE WHEN p.prev_index > ends.last THEN ends.last + 1 WHEN runs.term <> p.prev_term THEN runs.lo END AS hint
  FROM p JOIN ends ON ends.node = p.node LEFT JOIN runs ON runs.node = p.node AND p.prev_index BETWEEN runs.lo AND runs.hi""",
    "log_compacted": f"WITH {fixtures.REPLICAS} SELECT * FROM replicas WHERE index > CASE node WHEN 1 THEN 3000 WHEN 2 THEN 9000 ELSE 0 END",
    "log_compaction_allowed": f"WITH {NODES_SQL} SELECT node, 4500 < applied AND applied <= commit AS allowed FROM nodes",
    "follower_commit": "SELECT event_id AS id, greatest(event_id % 90, least(event_id % 100, event_id % 80 + event_id % 9)) AS new_commit FROM events",
    "committed_entries": f"WITH {fixtures.REPLICAS} SELECT * FROM replicas WHERE node = 2 AND index > 400 AND index <= 900",
    "snapshot_install": f"""WITH {fixtures.REPLICAS}, o AS (SELECT event_id % 3 + 1 AS node, 3000::BIGINT AS commit, event_id + 1 AS last_index, CAST(floor((event_id + 1) / 1000 + 1 - (event_id % 20) / 20) AS BIGINT) AS last_term FROM events)
  SELECT o.*, CASE WHEN o.last_index <= o.commit THEN 'stale' WHEN r.term IS NOT DISTINCT FROM o.last_term THEN 'keep_suffix' ELSE 'reset' END AS decision FROM o LEFT JOIN replicas r ON r.node = o.node AND r.index = o.last_index""",
    "log_accessors": f"WITH {fixtures.REPLICAS} SELECT node, min(index) AS first_index, max(index) AS last_index, arg_max(term, index) AS last_term, count(*) AS entries FROM replicas GROUP BY node",
    "log_gaps": f"WITH {fixtures.REPLICAS}, w AS (SELECT node, index, lag(index) OVER (PARTITION BY node ORDER BY index) AS before FROM replicas WHERE index % 1000 <> 7) SELECT * FROM w WHERE before IS NOT NULL AND index <> before + 1",
    "step_downs": """WITH c AS (SELECT event_id % 3 + 1 AS node, CASE WHEN event_id % 2 = 0 THEN 'leader' ELSE 'follower' END AS role, event_id AS old, event_id + 4 AS new FROM events)
  SELECT *, role = 'leader' AND ((node = 1 AND 60 > old AND 60 <= new) OR (node = 2 AND 33 > old AND 33 <= new)) AS steps_down FROM c""",
    "snapshots_taken": f"""WITH {fixtures.REPLICAS}, c AS (SELECT node, max(index) - 30 AS commit FROM replicas GROUP BY node)
  SELECT c.node, c.commit - 5 AS last_index, r.term AS last_term, CASE c.node WHEN 1 THEN '1,3,4,2' ELSE '1,2' END AS voters FROM c JOIN replicas r ON r.node = c.node AND r.index = c.commit - 5 WHERE c.node <> 2""",
    "log_after_offers": f"""WITH {fixtures.REPLICAS}, o AS (SELECT event_id % 3 + 1 AS node, event_id + 1 AS last_index, CAST(floor((event_id + 1) / 1000 + 1 - (event_id % 20) / 20) AS BIGINT) AS last_term FROM events),
  x AS (SELECT DISTINCT o.node FROM o LEFT JOIN replicas r ON r.node = o.node AND r.index = o.last_index WHERE (o.node = 2 OR o.last_index = 12) AND o.last_index > 3000 AND r.term IS DISTINCT FROM o.last_term)
  SELECT node, count(*) AS entries FROM replicas WHERE node NOT IN (SELECT node FROM x) GROUP BY node""",
    "progress_window": """WITH RECURSIVE e AS (SELECT user_id % 5 AS peer, event_id % 64 + 1 AS n, CASE WHEN event_id % 11 < 5 THEN 'sent' WHEN event_id % 11 < 9 THEN 'ok' WHEN event_id % 11 = 9 THEN 'reject' WHEN event_id // 11 % 2 = 0 THEN 'snapshot' ELSE 'installed' END AS kind,
    CASE WHEN event_id % 11 < 9 THEN event_id % 700 WHEN event_id % 11 = 9 THEN CASE WHEN event_id % 2 = 1 THEN event_id % 300 ELSE 0 END ELSE event_id % 500 END AS i, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS rn FROM events),
  s AS (SELECT DISTINCT peer, 0::BIGINT AS rn, 0::BIGINT AS matched, 1::BIGINT AS next, 0::BIGINT AS inflight, false AS pending_snapshot FROM e
    UNION ALL SELECT e.peer, e.rn, CASE WHEN e.kind IN ('ok', 'installed') THEN greatest(s.matched, e.i) ELSE s.matched END,
      CASE WHEN e.kind = 'sent' THEN s.next + e.n WHEN e.kind IN ('ok', 'installed') THEN greatest(s.next, e.i + 1) WHEN e.kind = 'reject' AND e.i > 0 THEN greatest(1, least(e.i, 401)) ELSE s.next END,
      CASE WHEN e.kind = 'sent' THEN s.inflight + 1 WHEN e.kind = 'ok' THEN greatest(s.inflight - 1, 0) WHEN e.kind = 'installed' OR (e.kind = 'reject' AND e.i > 0) THEN 0 ELSE s.inflight END,
      CASE e.kind WHEN 'snapshot' THEN true WHEN 'installed' THEN false ELSE s.pending_snapshot END FROM s JOIN e ON e.peer = s.peer AND e.rn = s.rn + 1)
  SELECT peer, matched, next, inflight, pending_snapshot FROM s QUALIFY row_number() OVER (PARTITION BY peer ORDER BY rn DESC) = 1""",
    "send_gate": "SELECT event_id AS id, event_id + 1 <= CASE event_id % 3 WHEN 0 THEN 700 WHEN 1 THEN 90 ELSE 0 END AS send FROM events",
    "append_replies": f"""WITH {fixtures.REPLICAS}, r AS (SELECT *, index - row_number() OVER (PARTITION BY node, term ORDER BY index) AS island FROM replicas),
  runs AS (SELECT node, term, min(index) AS lo, max(index) AS hi FROM r GROUP BY node, term, island), ends AS (SELECT node, max(index) AS last FROM replicas GROUP BY node),
  p AS (SELECT event_id AS id, event_id % 3 + 1 AS node, event_id + 1 AS i, (event_id + 1) // 1000 + 1 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS t, event_id % 9 AS n FROM events),
  h AS (SELECT p.*, CASE WHEN p.i > ends.last THEN ends.last + 1 WHEN runs.term <> p.t THEN runs.lo END AS hint FROM p JOIN ends ON ends.node = p.node LEFT JOIN runs ON runs.node = p.node AND p.i BETWEEN runs.lo AND runs.hi)
  SELECT id, node, hint IS NULL AS success, CASE WHEN hint IS NULL THEN i + n ELSE 0 END AS match_index, coalesce(hint, 0) AS conflict_index FROM h""",
    "output_emptiness": "SELECT event_id AS id, event_id % 2 <> 0 AND event_id % 3 = 0 AND event_id % 5 <> 0 AS empty FROM events",
    "progress_from_acks": "SELECT user_id % 5 AS peer, max(event_id) AS matched, max(event_id) + 1 AS next FROM events GROUP BY 1",
    "send_decision": """WITH p AS (SELECT event_id AS id, event_id % 300 + 1 AS next, event_id % 13 AS inflight, event_id % 6 = 0 AND event_id % 21 < 10 AS waiting FROM events),
  x AS (SELECT *, CASE WHEN waiting THEN 'suppressed' WHEN next <= 40 THEN 'snapshot' WHEN next <= 250 AND inflight < 10 THEN 'append' ELSE 'heartbeat' END AS send FROM p)
  SELECT id, send, CASE WHEN send = 'append' THEN least(64, 250 - next + 1) ELSE 0 END AS n_entries,
    CASE WHEN send = 'append' THEN inflight + 1 WHEN send = 'heartbeat' AND next <= 250 AND inflight >= 10 THEN inflight - 1 ELSE inflight END AS new_inflight FROM x""",
    "node_recovery": f"WITH {NODES_SQL} SELECT node, term, 'follower' AS role, CASE WHEN node <> 2 THEN applied ELSE 0 END AS commit, CASE WHEN node = 1 THEN '1,4' ELSE '1,2,3' END AS voters FROM nodes",
    "hard_state_changes": """WITH h AS (SELECT user_id AS node, event_id AS step, event_id // 100 AS term, CASE WHEN event_id % 3 <> 0 THEN event_id // 150 % 4 END AS voted_for FROM events),
  w AS (SELECT *, lag(term) OVER o AS t0, lag(voted_for) OVER o AS v0, row_number() OVER o AS rn FROM h WINDOW o AS (PARTITION BY node ORDER BY step))
  SELECT node, step, term, voted_for FROM w WHERE rn = 1 OR term IS DISTINCT FROM t0 OR voted_for IS DISTINCT FROM v0""",
    "log_persisted": f"WITH {fixtures.REPLICAS} SELECT * FROM replicas WHERE (node = 3 AND index < 9800) OR (node = 1 AND index >= 9800)",
    "election_safety": "SELECT event_id // 60 AS term, count(DISTINCT CASE WHEN event_id % 480 < 430 THEN 0 ELSE user_id % 2 END) AS leaders FROM events GROUP BY 1 HAVING count(DISTINCT CASE WHEN event_id % 480 < 430 THEN 0 ELSE user_id % 2 END) > 1",
    "state_machine_safety": f"WITH {fixtures.REPLICAS} SELECT index, count(DISTINCT (term, payload)) AS entries FROM replicas GROUP BY index HAVING count(DISTINCT (term, payload)) > 1",
    "log_matching": f"WITH {fixtures.REPLICAS}, r AS (SELECT index, term, kind, CASE WHEN node = 2 AND index % 100 = 0 THEN 'changed' ELSE payload END AS payload FROM replicas) SELECT index, term, count(DISTINCT (kind, payload)) AS entries FROM r GROUP BY index, term HAVING count(DISTINCT (kind, payload)) > 1",
    "convergence": f"""WITH {fixtures.REPLICAS}, r AS (SELECT * FROM replicas),
  c AS (SELECT true AS all_up, (SELECT count(DISTINCT m) = 1 FROM (SELECT max(index) AS m FROM r GROUP BY node)) AS same_applied, NOT EXISTS (SELECT 1 FROM r GROUP BY index HAVING count(DISTINCT (term, payload)) > 1 OR count(*) < 3) AS same_state, true AS has_leader)
  SELECT *, all_up AND same_applied AND same_state AND has_leader AS converged FROM c""",
    "logs_converged": f"WITH {fixtures.REPLICAS} SELECT (SELECT count(DISTINCT last) = 1 FROM (SELECT max(index) AS last FROM replicas GROUP BY node)) AS same_end, (SELECT count(*) FROM (SELECT index FROM replicas GROUP BY index HAVING count(DISTINCT term) > 1)) AS different_terms",
    "overwritten_commits": f"WITH {NODES_SQL}, {fixtures.REPLICAS} SELECT a.node, a.index, a.term AS held, b.term FROM replicas a JOIN replicas b ON a.node = 3 AND b.node = 1 AND a.index = b.index AND a.term <> b.term JOIN nodes n ON n.node = 3 AND a.index <= n.commit + 5900",
    "event_budget": "SELECT user_id AS seed, count(*) AS events FROM events GROUP BY 1 HAVING count(*) > 70",
    "determinism": "SELECT event_id, event_type, 'first' AS only_in FROM events WHERE event_id % 1000 = 1 UNION ALL SELECT event_id, 'x', 'second' FROM events WHERE event_id % 1000 = 1",
    "session_uniqueness": "WITH c AS (SELECT event_id * 2 + CASE WHEN event_id % 900 = 5 THEN 2 ELSE 0 END AS session_id FROM events) SELECT session_id, count(*) AS clients FROM c GROUP BY 1 HAVING count(*) > 1",
}
