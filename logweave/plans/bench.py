"""Registered queries of metrics, history checks, workload and fault generation, hashes and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave import schema
from logweave.functions import order, unsigned
from logweave.operators import checks, maintenance, metrics, workload
from logweave.sources import fixtures

KEYS, SEED = 10_000, 11


#: Values are beyond 2**53, where doubles are 256 apart.
BIG = 1 << 60


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of one register per user. A user's events take effect one after the other, ten stamps apart, and each
    is open for up to 24 stamps before and after, so up to five overlap. Purchases and signups write; errors swap: even
    ones what is there, odd ones something that never is; others read. Every 50th write or read never returns.

    That is linearizable by construction, but for three kinds of users: of those with user_id % 10 = 7 every read
    returns a number beside the one that was written, of those with 3 the swaps that can't succeed say they did, and of
    those with 5 the reads from the 40th event on return the first write, if others that do not overlap came between."""
    e, i = fixtures.events(spark, sf_dir), F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    op = F.when(F.col("event_type").isin("purchase", "signup"), "write").when(F.col("event_type") == "error", "cas").otherwise("read")
    value = i * 2 + BIG
    e = e.select("event_id", "user_id", op.alias("op"), F.row_number().over(w).alias("rn"))
    e = e.withColumn("took", F.when((F.col("op") == "write") | (F.col("op") == "cas") & (i % 2 == 0), value))
    e = e.withColumn("held", F.last("took", ignorenulls=True).over(ahead))
    e = e.withColumn("pending", (i % 50 == 0) & (F.col("op") != "cas"))
    wrote = F.when((F.col("op") == "write") & ~F.col("pending"), F.struct("rn", "took"))
    e = e.withColumn("first", F.min(wrote).over(Window.partitionBy("user_id"))).withColumn("latest", F.max(wrote).over(w.rowsBetween(Window.unboundedPreceding, -7)))
    kind, miss = F.col("user_id") % 10, (F.col("op") == "cas") & (i % 2 != 0)
    stale = (kind == 5) & (F.col("rn") >= 40) & (F.col("latest.rn") >= F.col("first.rn") + 7)
    seen = F.when(kind == 7, F.col("held") + 1).when(stale, F.col("first.took")).otherwise(F.col("held"))
    t = F.col("rn").cast("bigint") * 10
    return e.select(
        F.col("user_id").alias("key"), (i % 3).alias("client"), (t - i * 7 % 25).alias("invoke"), F.when(~F.col("pending"), t + i * 11 % 25).alias("ret"), "op",
        F.when(F.col("op") == "write", F.col("took")).when((F.col("op") == "read") & ~F.col("pending"), seen).alias("value"),
        F.when(F.col("op") == "cas", F.when(miss, F.lit(-5)).otherwise(F.col("held"))).alias("expect"), F.when(F.col("op") == "cas", value).alias("new"),
        F.when(F.col("op") == "cas", ~miss | (kind == 3)).alias("success"),
    )


#: The same history as SQL, with what is wrong with each row.
_HISTORY = f"""e AS (SELECT event_id, user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' WHEN event_type = 'error' THEN 'cas' ELSE 'read' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  t AS (SELECT *, event_id % 50 = 0 AND op <> 'cas' AS pending, CASE WHEN op = 'write' OR (op = 'cas' AND event_id % 2 = 0) THEN event_id * 2 + {BIG} END AS took FROM e),
  l AS (SELECT *, last_value(took IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
    min(rn) FILTER (op = 'write' AND NOT pending) OVER (PARTITION BY user_id) AS first, max(rn) FILTER (op = 'write' AND NOT pending) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 7 PRECEDING) AS latest FROM t),
  history AS (SELECT user_id AS key, rn * 10 - event_id * 7 % 25 AS invoke, op, pending, user_id % 10 = 7 AND op = 'read' AND NOT pending AND held IS NOT NULL AS beside,
    user_id % 10 = 3 AND op = 'cas' AND event_id % 2 <> 0 AS lies, coalesce(user_id % 10 = 5 AND op = 'read' AND NOT pending AND rn >= 40 AND latest >= first + 7, false) AS stale FROM l)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.events(spark, sf_dir)
    return e.groupBy(F.col("user_id").alias("seed")).agg(F.count(F.lit(1)).alias("ops"), F.sum("event_id").alias("events"), (F.max(F.col("event_id") % 997) == 996).alias("failed")).withColumn("seconds", F.lit(2))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    mode = F.element_at(F.array(*map(F.lit, ["stale", "lease", "linearizable"])), (i % 3 + 1).cast("int"))
    answer = F.when(i % 10 == 0, "not_leader").when(i % 15 == 1, "retry").when(i % 28 == 2, "timeout").otherwise("ok")
    return fixtures.events(spark, sf_dir).select((F.col("user_id") % 3 + 1).alias("node"), F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write").alias("kind"), mode.alias("mode"), answer.alias("answer"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.events(spark, sf_dir).select(F.col("event_id").alias("i"))


def _ycsb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by mix and kind over as many operations as there are events."""
    out = None
    for name in workload.MIXES:
        u = workload.uniform(F.lit(SEED), F.col("i") + 1)
        part = _numbers(spark, sf_dir).select(F.lit(name).alias("mix"), workload.mix(u, name).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("mix", "kind").agg(F.count(F.lit(1)).alias("n"))


def _zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    zetan = workload.zeta(spark, KEYS)
    return _numbers(spark, sf_dir).select("i", workload.zipf_rank(workload.uniform(F.lit(SEED), F.col("i") + 1), KEYS, zetan).alias("rank"))


def _fault_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every tenth event number, of three or five nodes."""
    i = F.col("event_id")
    return fixtures.events(spark, sf_dir).groupBy(F.floor(i / 10).alias("seed")).agg(F.max("event_id").alias("m")).select("seed", F.when(F.col("seed") % 2 == 0, 3).otherwise(5).alias("nodes"), F.lit(20_000).alias("end_ms"), F.lit(0.3).alias("partition"), F.lit(0.2).alias("crash"))


def _helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = unsigned.draw(F.lit(SEED), F.col("i") + 1)
    return _numbers(spark, sf_dir).select("i", unsigned.between(draw, 300, 800).alias("between"), unsigned.chance(draw, 0.3).alias("chance"), unsigned.pick(draw, ["a", "b", "c"]).alias("pick"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of events in the order in which they happen."""
    e = fixtures.events(spark, sf_dir)
    wakes = e.select((F.col("event_id") * 37 % 1009).alias("time"), F.col("event_id").alias("seq"), F.lit("wake").alias("event"))
    faults = e.where("event_type = 'error'").select((F.col("event_id") * 11 % 1009).alias("time"), (F.col("event_id") + 10_000_000).alias("seq"), F.lit("fault").alias("event"))
    return workload.event_queue(wakes, faults)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.events(spark, sf_dir).select((F.col("user_id") % 4).alias("part"), F.format_string("user%012d", "user_id").cast("binary").alias("key"))


def _bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and as many strangers against each part's filter: members are never denied, strangers seldom let in."""
    members = _users(spark, sf_dir).distinct()
    strangers = members.select("part", F.concat(F.col("key"), F.lit("x").cast("binary")).alias("key"))
    probes = members.withColumn("member", F.lit(True)).unionByName(strangers.withColumn("member", F.lit(False)))
    filters = maintenance.bloom(members, "part")
    found = maintenance.bloom_probe(probes.select("part", "key"), filters, "part")
    return probes.join(found, ["part", "key"]).groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.min("may_contain").alias("all_contained"), (F.count_if("may_contain") < 0.05 * F.count(F.lit(1))).alias("under_5_percent"))


QUERIES = {
    # AG1-AG7
    "latency_report": lambda s, d: metrics.latency_report(fixtures.samples(s, d)),
    "throughput": lambda s, d: metrics.throughput(fixtures.samples(s, d), 128),
    "timeline_minutes": lambda s, d: metrics.timeline(fixtures.samples(s, d), 60).select(F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("second"), "ops"),
    "counter_rate": lambda s, d: metrics.counter_rate(fixtures.events(s, d).groupBy(F.floor(F.col("event_id") / 100).alias("tick")).agg(F.max("event_id").alias("total"))),
    "failover_summary": lambda s, d: metrics.failover(fixtures.events(s, d).select((F.col("event_id") * 7 % 1013).alias("millis"))),
    "sample_percentiles": lambda s, d: metrics.percentile(fixtures.samples(s, d), 0.5).select(F.lit("p50").alias("q"), "value").unionByName(metrics.percentile(fixtures.samples(s, d), 0.99).select(F.lit("p99").alias("q"), "value")),
    "report_text": lambda s, d: metrics.report_lines(metrics.latency_report(fixtures.samples(s, d)), 12.8, 7),
    "sample_mean": lambda s, d: metrics.mean(metrics.merged(fixtures.samples(s, d).where("kind = 'view'"), fixtures.samples(s, d).where("kind = 'click'"))).select(F.round("mean", 3).alias("mean")),
    # AG8-AG13
    "node_metrics": lambda s, d: metrics.counters(_requests(s, d), fixtures.events(s, d).where("event_type = 'signup' and user_id % 3 != 1").select((F.col("user_id") % 3 + 1).alias("node"))),
    "apply_lag": lambda s, d: metrics.gauges(fixtures.events(s, d).select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("tick"), F.when(F.col("event_id") % 2 == 0, "leader").otherwise("follower").alias("role"), F.floor(F.col("event_id") / 99).alias("term"), F.col("event_id").alias("commit"), (F.col("event_id") - F.col("event_id") % 40 + 5).alias("applied"))),
    "metrics_exposition": lambda s, d: metrics.exposition(s.sql("SELECT * FROM VALUES (1L, 4L, 90L, 85L, 1, 5L) AS t(node, term, commit, applied, is_leader, lag)")),
    "sweep_totals": lambda s, d: metrics.sweep(_runs(s, d)).select("seeds", "ops", "events", F.array_join("failures", ",").alias("failures"), "seeds_per_min"),
    "history_summary": lambda s, d: checks.history_summary(_history(s, d)),
    # CK6-CK9
    "linearizability_by_key": lambda s, d: checks.linearizable(_history(s, d)),
    "impossible_reads": lambda s, d: checks.impossible_reads(_history(s, d)).select("key", "invoke"),
    "malformed_history": lambda s, d: checks.malformed(_history(s, d).withColumn("success", F.when(F.col("invoke") % 9 != 0, F.col("success"))).withColumn("op", F.when(F.col("invoke") % 99 == 0, "swap").otherwise(F.col("op")))).select("key", "invoke"),
    # WL1-WL10, WL12, WL13, WL17, WL18
    "splitmix_draws": lambda s, d: _numbers(s, d).select("i", unsigned.draw(F.lit(SEED), F.col("i") + 1).alias("draw"), workload.uniform(F.lit(SEED), F.col("i") + 1).alias("u")),
    "ycsb_mix": _ycsb,
    "zipf_ranks": _zipf,
    "scrambled_keys": lambda s, d: _numbers(s, d).select("i", workload.key_of(unsigned.scramble(F.col("i"), KEYS)).alias("key")),
    "workload_d": lambda s, d: workload.operations(s, "D", fixtures.events(s, d).count(), KEYS, SEED).select("op_index", "kind", "key", "scan_length"),
    "workload_e": lambda s, d: workload.operations(s, "E", fixtures.events(s, d).count(), KEYS, SEED).select("op_index", "kind", "key", "scan_length"),
    "run_plan": lambda s, d: workload.run_plan(s, "B", fixtures.events(s, d).count(), 32, KEYS, SEED).select("client", "op_index", "kind", "key"),
    "draw_helpers": _helpers,
    "event_queue": lambda s, d: order.numbered(_queue(s, d), ["time", "seq"], "place").select("place", "time", "seq", "event"),
    "load_partitions": lambda s, d: workload.load_ranges(s, 1003, 16),
    "read_modify_write": lambda s, d: workload.read_modify_write(fixtures.events(s, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("seen")), s.range(100).select(F.col("id").alias("key"), (F.col("id") % 3).alias("value"))),
    "fault_profiles": lambda s, d: workload.fault_profiles(_numbers(s, d).select(F.col("i").alias("seed"))),
    "client_operations": lambda s, d: workload.client_operations(_numbers(s, d)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")),
    "network_faults": lambda s, d: workload.deliver(fixtures.events(s, d).select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("sender"), (F.col("event_id") % 3).alias("receiver"), (F.col("event_id") * 2).alias("sent")), s.sql("SELECT * FROM VALUES (0L, 1L) AS t(sender, receiver)"), 0.1, 0.05, (1, 25)),
    "fault_schedule": lambda s, d: workload.fault_schedule(_fault_runs(s, d)).select("seed", "place", "time", "event", "asymmetric", "until", F.size("nodes").alias("n_nodes"), F.when(F.col("event") != "partition", F.array_join("nodes", ",")).alias("node")),
    "value_encoding": lambda s, d: _numbers(s, d).select("i", F.hex(workload.encode_value(F.col("i"))).alias("bytes"), workload.decode_value(workload.encode_value(F.col("i"))).alias("back")),
    "random_values": lambda s, d: workload.values(_numbers(s, d)).select("i", F.length("value").alias("n"), F.hex(F.substring("value", 1, 8)).alias("head")),
    # CL3
    "backoff_windows": lambda s, d: workload.backoff(_numbers(s, d).select("i", (F.col("i") % 9).cast("int").alias("attempt"), (F.col("i") % 101 / 100).alias("fraction")), 20, 500),
    # MT11-MT13
    "fnv1a": lambda s, d: _users(s, d).distinct().select(F.col("key").cast("string").alias("key"), unsigned.fnv1a(F.col("key")).alias("h")),
    "bloom_positions": lambda s, d: maintenance.bloom_positions(_users(s, d).select("key").distinct(), F.lit(1504), 6).select(F.col("key").cast("string").alias("key"), F.posexplode("positions").alias("i", "bit")),
    "bloom_probe": _bloom_probe,
}


def _draws(name: str, source: str, state: str) -> str:
    """CTEs that end in `name`: the rows of source with column z, the generator's output for a state expression."""
    m, g = 18446744073709551616, unsigned.GOLDEN
    return f"""{name}0 AS (SELECT *, (({state}) % {m})::UBIGINT AS x FROM {source}),
  {name}1 AS (SELECT *, (xor(x, x // 1073741824)::UHUGEINT * {unsigned.MIX_1} % {m})::UBIGINT AS y FROM {name}0),
  {name}2 AS (SELECT *, (xor(y, y // 134217728)::UHUGEINT * {unsigned.MIX_2} % {m})::UBIGINT AS w FROM {name}1),
  {name} AS (SELECT * EXCLUDE (x, y, w), xor(w, w // 2147483648) AS z FROM {name}2)"""


_SIGNED = "CASE WHEN {z} >= 9223372036854775808 THEN ({z}::HUGEINT - 18446744073709551616)::BIGINT ELSE {z}::BIGINT END"
_UNIT = "(z // 2048)::DOUBLE / 9007199254740992"
_STATE = f"{SEED}::UHUGEINT + (event_id + 1)::UHUGEINT * {unsigned.GOLDEN}"
#: FNV-1a of the ASCII text `key`, as an unsigned number.
_FNV = f"list_reduce(list_prepend({unsigned.FNV_OFFSET}::UHUGEINT, list_transform(string_split(key, ''), lambda c: ascii(c)::UHUGEINT)), lambda a, b: xor(a::UBIGINT, b::UBIGINT)::UHUGEINT * {unsigned.FNV_PRIME} % 18446744073709551616)::UBIGINT"
_USERS = "users AS (SELECT DISTINCT printf('user%012d', user_id) AS key FROM events)"
ORACLE_SQL = {
    "fnv1a": f"WITH {_USERS}, h AS (SELECT key, {_FNV} AS z FROM users) SELECT key, {_SIGNED.format(z='z')} AS h FROM h",
    "bloom_positions": f"""WITH {_USERS}, h AS (SELECT key, {_FNV} AS h FROM users), {_draws('d', 'h', 'h::UHUGEINT')}, o AS (SELECT key, h, (z // 2 * 2 + 1)::UHUGEINT AS h2, unnest(range(6)) AS i FROM d)
  SELECT key, i::INT AS i, ((h::UHUGEINT + i::UHUGEINT * h2) % 18446744073709551616 % 1504)::BIGINT AS bit FROM o""",
    "client_operations": f"""WITH s AS (SELECT event_id, unnest([1, 2]) AS p FROM events), {_draws('d', 's', f'3::UHUGEINT + (event_id * 2 + p)::UHUGEINT * {unsigned.GOLDEN}')},
  w AS (SELECT event_id, max(z) FILTER (p = 1) AS a, max(z) FILTER (p = 2) AS b FROM d GROUP BY event_id),
  k AS (SELECT CASE WHEN (a // 2048)::DOUBLE / 9007199254740992 < 0.4::DOUBLE THEN 'read' WHEN (a // 2048)::DOUBLE / 9007199254740992 < 0.4::DOUBLE + 0.4::DOUBLE THEN 'write' ELSE 'cas' END AS kind, (b % 4)::BIGINT AS key FROM w)
  SELECT kind, key, count(*) AS n FROM k GROUP BY kind, key""",
    "latency_report": f"""WITH {fixtures.SAMPLES}, g AS (SELECT kind, micros, row_number() OVER (PARTITION BY kind ORDER BY micros) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM samples WHERE NOT failed)
  SELECT kind, max(n) AS n, sum(micros)::DOUBLE / count(*) AS mean, {', '.join(f"max(micros) FILTER (i = floor((n - 1) * {q} + 0.5)) AS {k}" for k, q in metrics.QUANTILES.items())} FROM g GROUP BY kind""",
    "throughput": f"WITH {fixtures.SAMPLES} SELECT count(*) FILTER (NOT failed) AS ops, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed) / 128.0::DOUBLE AS ops_per_s FROM samples",
    "timeline_minutes": f"""WITH {fixtures.SAMPLES}, c AS (SELECT date_trunc('minute', ts) AS s, count(*) AS ops FROM samples GROUP BY 1)
  SELECT strftime(g.s, '%Y-%m-%d %H:%M:%S') AS second, coalesce(c.ops, 0) AS ops FROM (SELECT unnest(generate_series(min(s), max(s), INTERVAL 1 MINUTE)) AS s FROM c) g LEFT JOIN c ON c.s = g.s""",
    "counter_rate": "WITH r AS (SELECT event_id // 100 AS tick, max(event_id) AS total FROM events GROUP BY 1) SELECT *, total - coalesce(lag(total) OVER (ORDER BY tick), 0) AS done FROM r",
    "failover_summary": "WITH t AS (SELECT list_sort(list(event_id * 7 % 1013)) AS s FROM events) SELECT s[1] AS min_ms, s[(len(s) + 1) // 2] AS median_ms, s[len(s)] AS max_ms FROM t",
    "sample_percentiles": f"WITH {fixtures.SAMPLES}, g AS (SELECT micros, row_number() OVER (ORDER BY micros) - 1 AS i, count(*) OVER () AS n FROM samples) SELECT 'p50' AS q, max(micros) FILTER (i = floor((n - 1) * 0.5 + 0.5)) AS value FROM g UNION ALL SELECT 'p99', max(micros) FILTER (i = floor((n - 1) * 0.99 + 0.5)) FROM g",
    "sample_mean": f"WITH {fixtures.SAMPLES} SELECT round(avg(micros), 3) AS mean FROM samples WHERE kind IN ('view', 'click')",
    # a proposal and a linearizable read count when accepted, a lease read when served, a stale one always
    "node_metrics": """WITH r AS (SELECT user_id % 3 + 1 AS node, event_type IN ('view', 'click') AS rd, event_id % 3 AS m, CASE WHEN event_id % 10 = 0 THEN 'not_leader' WHEN event_id % 15 = 1 THEN 'retry' WHEN event_id % 28 = 2 THEN 'timeout' ELSE 'ok' END AS a FROM events),
  s AS (SELECT user_id % 3 + 1 AS node, count(*) AS n FROM events WHERE event_type = 'signup' AND user_id % 3 <> 1 GROUP BY 1)
  SELECT r.node, count(*) FILTER (NOT rd AND a NOT IN ('not_leader', 'retry')) AS proposals, count(*) FILTER (NOT rd AND a = 'ok') AS applied, count(*) FILTER (rd AND m = 0) AS reads_stale, count(*) FILTER (rd AND m = 1 AND a = 'ok') AS reads_lease,
    count(*) FILTER (rd AND m = 2 AND a NOT IN ('not_leader', 'retry')) AS reads_linearizable, count(*) FILTER (a = 'not_leader') AS not_leader, count(*) FILTER (a IN ('retry', 'timeout')) AS retries, coalesce(max(s.n), 0) AS snapshots
  FROM r LEFT JOIN s ON s.node = r.node GROUP BY r.node""",
    "apply_lag": """WITH l AS (SELECT user_id % 5 AS node, max(event_id) AS e FROM events GROUP BY 1)
  SELECT node, e // 99 AS term, e AS commit, e - e % 40 + 5 AS applied, CASE WHEN e % 2 = 0 THEN 1 ELSE 0 END AS is_leader, greatest(e - (e - e % 40 + 5), 0) AS lag FROM l""",
    "metrics_exposition": """SELECT 1::BIGINT AS node, unnest(['term{node="1"} 4', 'commit{node="1"} 90', 'applied{node="1"} 85', 'is_leader{node="1"} 1', 'lag{node="1"} 5']) AS line""",
    "sweep_totals": """WITH r AS (SELECT user_id AS seed, count(*) AS ops, sum(event_id)::BIGINT AS events, max(event_id % 997) = 996 AS failed FROM events GROUP BY 1)
  SELECT count(*) AS seeds, sum(ops)::BIGINT AS ops, sum(events)::BIGINT AS events, coalesce(string_agg(seed::VARCHAR, ',' ORDER BY seed) FILTER (failed), '') AS failures, count(*) * 60 / (count(*) * 2.0::DOUBLE) AS seeds_per_min FROM r""",
    "history_summary": f"WITH {_HISTORY} SELECT count(*) AS ops, count(DISTINCT key) AS keys, count(*) FILTER (pending) AS pending FROM history",
    # linearizable but where the history was made wrong
    "linearizability_by_key": f"WITH {_HISTORY} SELECT key, NOT bool_or(beside OR lies OR stale) AS ok, CASE WHEN bool_or(beside OR lies OR stale) THEN 'not linearizable' ELSE '' END AS reason FROM history GROUP BY key",
    "impossible_reads": f"WITH {_HISTORY} SELECT key, invoke FROM history WHERE beside",
    "malformed_history": f"WITH {_HISTORY} SELECT key, invoke FROM history WHERE invoke % 99 = 0 OR (op = 'cas' AND invoke % 9 = 0)",
    "report_text": f"""WITH {fixtures.SAMPLES}, g AS (SELECT kind, micros, row_number() OVER (PARTITION BY kind ORDER BY micros) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM samples WHERE NOT failed),
  k AS (SELECT kind, max(n) AS n, sum(micros)::DOUBLE / count(*) AS mean, {', '.join(f"max(micros) FILTER (i = floor((n - 1) * {q} + 0.5)) AS {k}" for k, q in metrics.QUANTILES.items())} FROM g GROUP BY kind)
  SELECT 0 AS place, printf('%d ops in 12.80s = %.0f ops/sec (7 errors)', sum(n)::BIGINT, sum(n) / 12.8::DOUBLE) AS line FROM k
  UNION ALL SELECT 1, 'op           count   mean_us    p50_us    p95_us    p99_us   p999_us'
  UNION ALL SELECT row_number() OVER (ORDER BY kind) + 1, printf('%-8s %9d %9.0f %9d %9d %9d %9d', kind, n, mean, p50, p95, p99, p999) FROM k""",
    "splitmix_draws": f"WITH {_draws('d', 'events', _STATE)} SELECT event_id AS i, {_SIGNED.format(z='z')} AS draw, {_UNIT} AS u FROM d",
    "scrambled_keys": f"""WITH a AS (SELECT event_id, (event_id::UHUGEINT * {unsigned.SCRAMBLE_1} % 18446744073709551616)::UBIGINT AS x FROM events)
  SELECT event_id AS i, printf('user%012d', (((xor(x, x // 8589934592)::UHUGEINT * {unsigned.SCRAMBLE_2}) % 18446744073709551616) % {KEYS})::BIGINT) AS key FROM a""",
    "load_partitions": "SELECT range AS client, least(range * 63, 1003) AS first, least((range + 1) * 63, 1003) AS \"end\" FROM range(16)",
    "read_modify_write": "SELECT event_id AS id, user_id AS key, event_id % 3 IS NOT DISTINCT FROM CASE WHEN user_id < 100 THEN user_id % 3 END AS won, true AS done FROM events",
    "fault_profiles": f"""WITH s AS (SELECT event_id AS seed, unnest(range(1, 7)) AS p FROM events), {_draws('d', 's', f'xor(seed::UBIGINT, {unsigned.PROFILE_SEED}::UBIGINT)::UHUGEINT + (p + 1)::UHUGEINT * {unsigned.GOLDEN}')},
  w AS (SELECT seed, max(z) FILTER (p = 1) AS a, max(z) FILTER (p = 2) AS b, max(z) FILTER (p = 3) AS c, max(z) FILTER (p = 4) AS e, max(z) FILTER (p = 5) AS f, max(z) FILTER (p = 6) AS g FROM d GROUP BY seed)
  SELECT seed, ([3, 3, 3, 5])[(a % 4)::INT + 1] AS nodes, ([0.0, 0.02, 0.10, 0.20]::DOUBLE[])[(b % 4)::INT + 1] AS msg_drop, ([0.0, 0.05]::DOUBLE[])[(c % 2)::INT + 1] AS msg_dup, (3 + e % 23)::BIGINT AS max_delay_ms,
    ([0.0, 0.15, 0.30]::DOUBLE[])[(f % 3)::INT + 1] AS partition_prob, ([0.0, 0.10, 0.20]::DOUBLE[])[(g % 3)::INT + 1] AS crash_prob, 3 AS clients, 4 AS keys, 20000 AS run_ms, 8000 AS quiet_ms, 1 AS min_delay_ms, 60 AS snapshot_every FROM w""",
    "value_encoding": "SELECT event_id AS i, upper(substr(lpad(to_hex(event_id), 16, '0'), 15, 2) || substr(lpad(to_hex(event_id), 16, '0'), 13, 2) || substr(lpad(to_hex(event_id), 16, '0'), 11, 2) || substr(lpad(to_hex(event_id), 16, '0'), 9, 2) || '00000000') AS bytes, event_id AS back FROM events",
    "backoff_windows": """WITH t AS (SELECT event_id AS i, CAST(event_id % 9 AS INT) AS attempt, event_id % 101 / 100 AS fraction FROM events), w AS (SELECT *, least(20 * CAST(pow(2, least(attempt, 6)) AS BIGINT), 500) AS window_ms FROM t)
  SELECT *, window_ms * greatest(fraction, 0.1::DOUBLE) AS wait_ms FROM w""",
}
#: The zipf rank of a uniform double u.
_ALPHA, _ZETA2 = 1 / (1 - schema.ZIPF_THETA), 1 + 0.5**schema.ZIPF_THETA
_ZETA = f"zeta AS (SELECT sum(1.0::DOUBLE / pow(range::DOUBLE, {schema.ZIPF_THETA}::DOUBLE)) AS zetan FROM range(1, {KEYS + 1})), eta AS (SELECT zetan, (1 - {(2 / KEYS) ** (1 - schema.ZIPF_THETA)!r}::DOUBLE) / (1 - {_ZETA2!r}::DOUBLE / zetan) AS eta FROM zeta)"
_RANK = f"CASE WHEN u * zetan < 1 THEN 0 WHEN u * zetan < {_ZETA2!r}::DOUBLE THEN 1 ELSE floor({KEYS}::DOUBLE * pow(eta * u - eta + 1, {_ALPHA!r}::DOUBLE)) END::BIGINT"
ORACLE_SQL["zipf_ranks"] = f"WITH {_draws('d', 'events', _STATE)}, {_ZETA}, u AS (SELECT event_id, {_UNIT} AS u FROM d) SELECT event_id AS i, {_RANK} AS rank FROM u, eta"


def _scrambled(rank: str, source: str) -> str:
    """CTEs that end in `scrambled`: the rows of source with column index, the rank's place in the keyspace."""
    return f"""scrambled0 AS (SELECT *, (({rank})::UHUGEINT * {unsigned.SCRAMBLE_1} % 18446744073709551616)::UBIGINT AS x FROM {source}),
  scrambled AS (SELECT * EXCLUDE (x), ((xor(x, x // 8589934592)::UHUGEINT * {unsigned.SCRAMBLE_2}) % 18446744073709551616 % {KEYS})::BIGINT AS index FROM scrambled0)"""


def _operations(name: str) -> str:
    """CTEs that end in `operations`: (op_index, kind, key, scan_length) of a run with as many operations as events."""
    share, first, second = workload.MIXES[name]
    recent = f"{KEYS} - 1 - (b % {schema.RECENT_INSERTS})::BIGINT" if name == "D" else "index"
    return f"""{_ZETA}, s AS (SELECT event_id, unnest([1, 2, 3]) AS p FROM events), {_draws('d', 's', f'{SEED}::UHUGEINT + (event_id * 3 + p)::UHUGEINT * {unsigned.GOLDEN}')},
  w AS (SELECT event_id, max(z) FILTER (p = 1) AS a, max(z) FILTER (p = 2) AS b, max(z) FILTER (p = 3) AS c FROM d GROUP BY event_id),
  k AS (SELECT *, CASE WHEN (a // 2048)::DOUBLE / 9007199254740992 < {share}::DOUBLE THEN '{first}' ELSE '{second}' END AS kind, (b // 2048)::DOUBLE / 9007199254740992 AS u FROM w),
  ranked AS (SELECT *, {_RANK} AS rank FROM k, eta), {_scrambled('rank', 'ranked')},
  operations AS (SELECT event_id AS op_index, kind, printf('user%012d', CASE WHEN kind = 'insert' THEN {KEYS} + event_id ELSE {recent} END) AS key, CASE WHEN kind = 'scan' THEN (c % {schema.SCAN_LENGTH})::BIGINT + 1 END AS scan_length FROM scrambled)"""


ORACLE_SQL["workload_d"] = f"WITH {_operations('D')} SELECT * FROM operations"
ORACLE_SQL["workload_e"] = f"WITH {_operations('E')} SELECT * FROM operations"
ORACLE_SQL["run_plan"] = f"WITH {_operations('B')}, n AS (SELECT count(*) // 32 AS per FROM events) SELECT op_index // per AS client, op_index % per AS op_index, kind, key FROM operations, n WHERE op_index < per * 32"
ORACLE_SQL["draw_helpers"] = f"WITH {_draws('d', 'events', _STATE)} SELECT event_id AS i, (z % 501)::BIGINT + 300 AS between, z::DOUBLE / 18446744073709551615::DOUBLE < 0.3::DOUBLE AS chance, ['a', 'b', 'c'][(z % 3)::INT + 1] AS pick FROM d"
ORACLE_SQL["event_queue"] = """WITH q AS (SELECT event_id * 37 % 1009 AS time, event_id AS seq, 'wake' AS event FROM events UNION ALL SELECT event_id * 11 % 1009, event_id + 10000000, 'fault' FROM events WHERE event_type = 'error')
  SELECT row_number() OVER (ORDER BY time, seq) AS place, * FROM q"""
ORACLE_SQL["random_values"] = f"""WITH {_draws('d', 'events', f'7::UHUGEINT + (event_id * 13 + 1)::UHUGEINT * {unsigned.GOLDEN}')}, h AS (SELECT event_id, upper(lpad(to_hex(z), 16, '0')) AS x FROM d)
  SELECT event_id AS i, 100 AS n, {' || '.join(f'substr(x, {15 - 2 * k}, 2)' for k in range(8))} AS head FROM h"""
ORACLE_SQL["network_faults"] = f"""WITH m AS (SELECT event_id AS id, user_id % 3 AS sender, event_id % 3 AS receiver, event_id * 2 AS sent FROM events WHERE NOT (user_id % 3 = 0 AND event_id % 3 = 1)),
  s AS (SELECT *, unnest([1, 2, 3, 4]) AS p FROM m), {_draws('d', 's', f'5::UHUGEINT + (id * 4 + p)::UHUGEINT * {unsigned.GOLDEN}')},
  w AS (SELECT id, sender, receiver, sent, max(z) FILTER (p = 1) AS a, max(z) FILTER (p = 2) AS b, max(z) FILTER (p = 3) AS c, max(z) FILTER (p = 4) AS e FROM d GROUP BY ALL),
  k AS (SELECT *, unnest(CASE WHEN b::DOUBLE / 18446744073709551615::DOUBLE < 0.05::DOUBLE THEN [0, 1] ELSE [0] END) AS copy FROM w WHERE NOT a::DOUBLE / 18446744073709551615::DOUBLE < 0.1::DOUBLE)
  SELECT id, sender, receiver, sent, copy, sent + 1 + (CASE copy WHEN 0 THEN c ELSE e END % 25)::BIGINT AS time FROM k"""
_BITS = "greatest(count(*) * 10, 64)"
ORACLE_SQL["bloom_probe"] = f"""WITH u AS (SELECT DISTINCT user_id % 4 AS part, printf('user%012d', user_id) AS key FROM events), shape AS (SELECT part, ({_BITS} + 7) // 8 * 8 AS bits FROM u GROUP BY part),
  probes AS (SELECT part, key, true AS member FROM u UNION ALL SELECT part, key || 'x', false FROM u), h AS (SELECT *, {_FNV} AS h FROM probes), {_draws('d', 'h', 'h::UHUGEINT')},
  o AS (SELECT d.part, key, member, bits, h, (z // 2 * 2 + 1)::UHUGEINT AS h2, unnest(range(6)) AS i FROM d JOIN shape ON shape.part = d.part),
  p AS (SELECT part, key, member, ((h::UHUGEINT + i::UHUGEINT * h2) % 18446744073709551616 % bits::UHUGEINT)::BIGINT AS bit FROM o),
  f AS (SELECT DISTINCT part, bit FROM p WHERE member), t AS (SELECT p.part, p.key, p.member, bool_and(f.bit IS NOT NULL) AS hit FROM p LEFT JOIN f ON f.part = p.part AND f.bit = p.bit GROUP BY ALL)
  SELECT member, count(*) AS n, bool_and(hit) AS all_contained, count(*) FILTER (hit) < 0.05::DOUBLE * count(*) AS under_5_percent FROM t GROUP BY member"""
_CHANCE = "{z}::DOUBLE / 18446744073709551615::DOUBLE < {p}::DOUBLE"
#: A run's steps one after the other, each from the numbers drawn before it: p, and when each node is up again.
ORACLE_SQL["fault_schedule"] = f"""WITH RECURSIVE runs AS (SELECT DISTINCT event_id // 10 AS seed, CASE WHEN event_id // 10 % 2 = 0 THEN 3 ELSE 5 END AS n FROM events), places AS (SELECT *, unnest(range(1, 1000)) AS p FROM runs),
  {_draws('d', 'places', f'seed::UHUGEINT + (p + 1)::UHUGEINT * {unsigned.GOLDEN}')}, l AS (SELECT seed, n, list(z ORDER BY p) AS zs FROM d GROUP BY seed, n),
  r AS (SELECT seed, n, zs, 0::BIGINT AS now, 0::BIGINT AS p, list_transform(range(n), lambda x: 0::BIGINT) AS up FROM l
    UNION ALL SELECT seed, n, zs, now + 300 + (zs[u + 1] % 501)::BIGINT, u + 1, CASE WHEN hit THEN list_transform(up, lambda x, i: CASE WHEN i = node THEN until ELSE x END) ELSE up END FROM (
      SELECT *, q + 1 + CASE WHEN cr THEN 1 ELSE 0 END + CASE WHEN hit THEN 1 ELSE 0 END AS u FROM (
        SELECT *, cr AND up[node] <= now AS hit, now + 300 + (zs[q + 3] % 3701)::BIGINT AS until FROM (
          SELECT *, {_CHANCE.format(z='zs[q + 1]', p=0.2)} AS cr, (zs[q + 2] % n)::BIGINT + 1 AS node FROM (
            SELECT *, p + 1 + CASE WHEN {_CHANCE.format(z='zs[p + 1]', p=0.3)} THEN n + 2 ELSE 0 END AS q FROM r WHERE now < 20000))))),
  s AS (SELECT *, {_CHANCE.format(z='zs[p + 1]', p=0.3)} AS part, p + 1 + CASE WHEN {_CHANCE.format(z='zs[p + 1]', p=0.3)} THEN n + 2 ELSE 0 END AS q FROM r),
  c AS (SELECT *, {_CHANCE.format(z='zs[q + 1]', p=0.2)} AS cr, (zs[q + 2] % n)::BIGINT + 1 AS node FROM s WHERE now < 20000),
  ends AS (SELECT *, unnest(range(1, n + 1)) AS node FROM s WHERE now >= 20000),
  f AS (SELECT seed, now AS time, 0 AS turn, 'partition' AS event, {_CHANCE.format(z='zs[p + n + 2]', p=0.3)} AS "asymmetric", now + 500 + (zs[p + n + 3] % 2501)::BIGINT AS until, (zs[p + n + 1] % (n - 1))::INT + 1 AS n_nodes, NULL AS node FROM s WHERE now < 20000 AND part
    UNION ALL SELECT seed, now, 1, 'crash', NULL, now + 300 + (zs[q + 3] % 3701)::BIGINT, 1, node::VARCHAR FROM c WHERE cr AND up[node] <= now
    UNION ALL SELECT seed, now, 2, 'heal', NULL, NULL, 0, '' FROM s WHERE now >= 20000
    UNION ALL SELECT seed, now, 2 + node, 'restart', NULL, now + 10 + (zs[p + row_number() OVER (PARTITION BY seed ORDER BY node)] % 41)::BIGINT, 1, node::VARCHAR FROM ends WHERE up[node] > now)
  SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY time, turn) - 1 AS INT) AS place, time, event, "asymmetric", until, n_nodes, node FROM f"""
ORACLE_SQL["ycsb_mix"] = f"WITH {_draws('d', 'events', _STATE)}, u AS (SELECT {_UNIT} AS u FROM d), m AS ({' UNION ALL '.join(f'''SELECT '{k}' AS mix, CASE WHEN u < {s} THEN '{a}' ELSE '{b}' END AS kind FROM u''' for k, (s, a, b) in workload.MIXES.items())}) SELECT mix, kind, count(*) AS n FROM m GROUP BY mix, kind"
