"""Registered queries of the command fold and of reads at a consistency mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import commands, reads
from logweave.shared import new_folder
from logweave.sources import fixtures
from logweave.streaming import apply as streaming


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.statuses(fixtures.commands(spark, sf_dir)).where("status = 'applied'")


#: node, role, leader, term, commit, applied, last_index, lease_valid, commit_term, read_confirmed
NODES = [
    (1, "leader", 1, 6, 5200, 5100, 5300, True, 6, True),
    (2, "follower", 1, 6, 5150, 5000, 5300, False, 6, False),
    (3, "leader", 3, 5, 4000, 4000, 4400, False, 4, False),
    (4, "leader", 4, 7, 5400, 5400, 5400, True, 7, True),
]
_NODE_COLUMNS = "node, role, leader, term, commit, applied, last_index, lease_valid, commit_term, read_confirmed"
_NODE_ROWS = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS BIGINT)" for x in r) + ")" for r in NODES)
NODES_SQL = f"nodes AS (SELECT * FROM (VALUES {_NODE_ROWS}) AS t({_NODE_COLUMNS}))"


def nodes(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_NODE_ROWS} AS t({_NODE_COLUMNS})")


def _read(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = reads.read(fixtures.mutations(spark, sf_dir), nodes(spark), mode)
        return found.select("node", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))

    return run


def stream_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command log read as a stream, de-duplicated with keyed state, and the table that the sink wrote."""
    folder, path = new_folder(spark, "stream"), f"{sf_dir}/events.parquet"
    # a glob, since a streaming source takes no single file
    source = streaming.log_source(spark, f"{path}*", spark.read.parquet(path).schema)
    streaming.write_statuses(fixtures.as_commands(source), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(streaming.STATUS_SCHEMA).parquet(f"{folder}/out")


def _key_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key at every node, in every mode."""
    found = [reads.read_key(fixtures.mutations(spark, sf_dir), nodes(spark), mode, F.lit("user000000000042").cast("binary")).withColumn("mode", F.lit(mode)) for mode in reads.MODES]
    return reduce(DataFrame.unionByName, found).select("mode", "node", "answer", "status", F.col("value").cast("string").alias("value"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of the folded log, and whether that of a restored fold is the same."""
    applied, table = _applied(spark, sf_dir), commands.sessions(fixtures.commands(spark, sf_dir))
    once = commands.image(commands.fold(applied)[1], table)
    half = commands.fold(applied.where("log_index <= 300"))[1]
    again = commands.image(commands.fold(applied.where("log_index > 300"), half)[1], table.repartition(3))
    both = once.unionByName(again)
    return both.agg(F.max("keys").alias("keys"), F.max("sessions").alias("sessions"), (F.count_distinct("keys", "kv_hash", "sessions", "session_hash") == 1).alias("same"))


QUERIES = {
    # CM1, CM2, CM11, D10
    "cmd_dedup_status": lambda s, d: commands.statuses(fixtures.commands(s, d)).select("log_index", "session_id", "client_seq", "status"),
    "cmd_cached_results": lambda s, d: commands.cached(fixtures.commands(s, d)),
    "cmd_validation": lambda s, d: commands.validated(fixtures.commands(s, d)).where("error is not null").select("log_index", "error"),
    "session_table": lambda s, d: commands.sessions(fixtures.commands(s, d)),
    # CM3-CM7, CM10, CM13
    "cmd_cas_results": lambda s, d: commands.fold(_applied(s, d))[0],
    "cmd_final_state": lambda s, d: commands.fold(_applied(s, d))[1],
    "cmd_responses": lambda s, d: commands.responses(commands.apply(fixtures.commands(s, d))[0]).select("log_index", "status", "result", "success", "actual", "error"),
    "cmd_progress": lambda s, d: commands.progress(fixtures.replicas(s, d)),
    # CM8, CM9: the log folded in two parts, the second from the first one's image
    "cmd_restored_state": lambda s, d: commands.fold(_applied(s, d).where("log_index > 4000"), commands.fold(_applied(s, d).where("log_index <= 4000"))[1])[1],
    "state_image": lambda s, d: _images(s, d),
    # RD1-RD5
    "read_stale": _read("stale"),
    "read_lease": _read("lease"),
    "read_linearizable": _read("linearizable"),
    "read_admission_modes": lambda s, d: reads.admit(nodes(s), "stale").withColumn("mode", F.lit("stale")).unionByName(reads.admit(nodes(s), "lease").withColumn("mode", F.lit("lease"))).unionByName(reads.admit(nodes(s), "linearizable").withColumn("mode", F.lit("linearizable"))).select("node", "mode", "answer", "read_index"),
    "read_release": lambda s, d: reads.release(fixtures.events(s, d).select((F.col("user_id") % 4 + 1).alias("node"), F.col("event_id").alias("read_id"), (F.col("event_id") + 1).alias("read_index")), nodes(s)),
    "read_key_modes": lambda s, d: _key_modes(s, d),
    # RD6-RD8, CL2
    "read_timeouts": lambda s, d: reads.expired(fixtures.events(s, d).select(F.col("event_id").alias("id"), (F.col("event_id") * 3 % 100 + 50).alias("deadline")), 75),
    "node_status": lambda s, d: reads.status(nodes(s).withColumn("voters", F.lit(3))),
    "proposal_errors": lambda s, d: reads.proposal_errors(fixtures.events(s, d).select("event_id", F.when(F.col("event_id") % 3 == 0, "leader").otherwise("follower").alias("role"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("leader"), (F.col("event_id") % 9 != 0).alias("ready"), (F.col("event_id") % 2 == 0).alias("is_conf"), (F.col("event_id") % 4 == 0).alias("conf_in_flight"))).select("event_id", "error"),
    "client_attempts": lambda s, d: reads.attempts(fixtures.events(s, d).select("event_id", (F.col("event_id") % 13).cast("int").alias("attempt"), F.element_at(F.array(*map(F.lit, ["ok", "error", "not_leader", "retry"])), (F.col("user_id") % 4 + 1).cast("int")).alias("answer"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("hint"))).select("event_id", "step"),
    # §2.11
    "stream_dedup_status": stream_statuses,
}

_STATUS = """st AS (SELECT *, CASE WHEN session_id = 0 OR last IS NULL OR client_seq > last THEN 'applied' WHEN client_seq = last THEN 'duplicate' ELSE 'stale' END AS status
  FROM (SELECT *, max(client_seq) OVER (PARTITION BY session_id ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM commands))"""
_FOLD = (
    _STATUS
    + """, ops AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY log_index) AS rn FROM st WHERE status = 'applied'),
  f AS (SELECT key, rn, log_index, op, CAST(NULL AS VARCHAR) AS seen, CASE WHEN op = 'put' THEN value WHEN op = 'cas' AND expect IS NULL THEN new END AS after, CASE WHEN op = 'cas' THEN expect IS NULL END AS success FROM ops WHERE rn = 1
    UNION ALL
    SELECT o.key, o.rn, o.log_index, o.op, f.after, CASE o.op WHEN 'put' THEN o.value WHEN 'delete' THEN NULL WHEN 'get' THEN f.after ELSE CASE WHEN f.after IS NOT DISTINCT FROM o.expect THEN o.new ELSE f.after END END,
      CASE WHEN o.op = 'cas' THEN f.after IS NOT DISTINCT FROM o.expect END
    FROM f JOIN ops o ON o.key = f.key AND o.rn = f.rn + 1),
  res AS (SELECT log_index, CASE op WHEN 'cas' THEN 'cas' WHEN 'get' THEN 'value' ELSE 'ok' END AS result, success, CASE WHEN op IN ('cas', 'get') THEN seen END AS actual FROM f)"""
)
_STATE = "SELECT key, after AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rn DESC) AS last FROM f) WHERE last = 1 AND after IS NOT NULL"


def _read_sql(gate: str) -> str:
    return f"WITH {fixtures.LOG}, {NODES_SQL}, v AS (SELECT n.node, l.*, row_number() OVER (PARTITION BY n.node, l.key ORDER BY l.seq DESC) AS rn FROM log l JOIN nodes n ON {gate}) SELECT node, key, value FROM v WHERE rn = 1 AND value IS NOT NULL"


_LINEAR = "CASE WHEN role <> 'leader' THEN 'not_leader' WHEN commit_term <> term THEN 'not_ready' WHEN NOT read_confirmed OR applied < commit THEN 'retry' ELSE 'serve' END"
_LEASE = "CASE WHEN role <> 'leader' THEN 'not_leader' WHEN lease_valid THEN 'serve' ELSE 'retry' END"
ORACLE_SQL = {
    "cmd_dedup_status": f"WITH {fixtures.COMMANDS}, {_STATUS} SELECT log_index, session_id, client_seq, status FROM st",
    "stream_dedup_status": f"WITH {fixtures.COMMANDS}, {_STATUS} SELECT log_index, session_id, client_seq, status FROM st",
    "cmd_cached_results": f"WITH {fixtures.COMMANDS}, {_STATUS} SELECT d.log_index, d.session_id, d.client_seq, a.log_index AS first_index FROM st d JOIN st a ON d.status = 'duplicate' AND a.status = 'applied' AND a.session_id = d.session_id AND a.client_seq = d.client_seq AND a.session_id <> 0 AND a.log_index < d.log_index",
    "cmd_validation": f"WITH {fixtures.COMMANDS} SELECT log_index, 'session required' AS error FROM commands WHERE session_id = 0 AND op <> 'get'",
    "session_table": f"WITH {fixtures.COMMANDS}, {_STATUS} SELECT session_id, max(client_seq) AS last_seq, max(log_index) AS last_index FROM st WHERE status = 'applied' AND session_id <> 0 GROUP BY session_id",
    "cmd_cas_results": f"WITH RECURSIVE {fixtures.COMMANDS}, {_FOLD} SELECT * FROM res",
    "cmd_final_state": f"WITH RECURSIVE {fixtures.COMMANDS}, {_FOLD} {_STATE}",
    "cmd_restored_state": f"WITH RECURSIVE {fixtures.COMMANDS}, {_FOLD} {_STATE}",
    "state_image": f"WITH RECURSIVE {fixtures.COMMANDS}, {_FOLD} SELECT (SELECT count(*) FROM ({_STATE})) AS keys, (SELECT count(DISTINCT session_id) FROM commands WHERE session_id <> 0) AS sessions, true AS same",
    "cmd_responses": f"""WITH RECURSIVE {fixtures.COMMANDS}, {_FOLD}, fin AS (SELECT st.log_index, st.session_id, st.client_seq, st.status, res.result, res.success, res.actual FROM st JOIN res ON res.log_index = st.log_index)
  SELECT log_index, status, result, success, actual, NULL AS error FROM fin
  UNION ALL SELECT d.log_index, d.status, f.result, f.success, f.actual, NULL FROM st d LEFT JOIN fin f ON f.session_id = d.session_id AND f.client_seq = d.client_seq AND f.session_id <> 0 WHERE d.status = 'duplicate'
  UNION ALL SELECT log_index, status, 'stale', NULL, NULL, 'stale sequence number' FROM st WHERE status = 'stale'""",
    "cmd_progress": f"WITH {fixtures.REPLICAS} SELECT node, max(index) AS applied_index, count(*) FILTER (kind = 'normal') AS commands FROM replicas GROUP BY node",
    "read_stale": _read_sql("l.seq <= n.applied"),
    "read_lease": _read_sql("n.role = 'leader' AND n.lease_valid AND l.seq <= n.applied"),
    "read_linearizable": _read_sql("n.role = 'leader' AND n.commit_term = n.term AND n.read_confirmed AND n.applied >= n.commit AND l.seq <= n.commit"),
    "read_admission_modes": f"WITH {NODES_SQL}, a AS (SELECT node, 'stale' AS mode, 'serve' AS answer, applied AS i FROM nodes UNION ALL SELECT node, 'lease', {_LEASE}, applied FROM nodes UNION ALL SELECT node, 'linearizable', {_LINEAR}, commit FROM nodes) SELECT node, mode, answer, CASE WHEN answer = 'serve' THEN i END AS read_index FROM a",
    "read_release": f"WITH {NODES_SQL} SELECT n.node, e.event_id AS read_id, e.event_id + 1 AS read_index, e.event_id + 1 <= n.applied AS ready FROM events e JOIN nodes n ON n.node = e.user_id % 4 + 1",
    "read_key_modes": f"""WITH {fixtures.LOG}, {NODES_SQL}, a AS (SELECT node, 'stale' AS mode, 'serve' AS answer, applied AS i FROM nodes UNION ALL SELECT node, 'lease', {_LEASE}, applied FROM nodes UNION ALL SELECT node, 'linearizable', {_LINEAR}, commit FROM nodes),
  v AS (SELECT a.mode, a.node, a.answer, max(l.seq) AS seq FROM a LEFT JOIN log l ON l.key = 'user000000000042' AND a.answer = 'serve' AND l.seq <= a.i GROUP BY ALL)
  SELECT v.mode, v.node, v.answer, CASE WHEN v.answer = 'serve' THEN CASE WHEN v.seq IS NULL THEN 'missing' WHEN l.value IS NULL THEN 'tombstone' ELSE 'live' END END AS status, l.value FROM v LEFT JOIN log l ON l.seq = v.seq""",
    "read_timeouts": "SELECT event_id AS id, event_id * 3 % 100 + 50 AS deadline, 'retry' AS answer FROM events WHERE event_id * 3 % 100 + 50 <= 75",
    "node_status": f"WITH {NODES_SQL} SELECT node, role, term, leader, commit, applied, last_index, 3 AS voters FROM nodes",
    "proposal_errors": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'not_leader:' || coalesce(CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END, 'none') WHEN event_id % 9 = 0 THEN 'retry' WHEN event_id % 2 = 0 AND event_id % 4 = 0 THEN 'configuration change in flight' END AS error FROM events",
    "client_attempts": """SELECT event_id, CASE WHEN a = 'ok' THEN 'done' WHEN a = 'error' THEN 'fail' WHEN event_id % 13 + 1 >= 12 THEN 'give_up' WHEN a = 'not_leader' AND event_id % 2 = 0 THEN 'jump_to_hint' WHEN a = 'not_leader' THEN 'next_address' ELSE 'same_node' END AS step
  FROM (SELECT *, ['ok', 'error', 'not_leader', 'retry'][user_id % 4 + 1] AS a FROM events)""",
}
