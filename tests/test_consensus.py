import itertools
import random

import pytest

from logweave import schema
from logweave.functions import unsigned
from logweave.operators import checks, metrics, reads, replication, workload


def entries(spark, rows):
    return spark.createDataFrame([(i, t, p) for i, t, p in rows], "index bigint, term bigint, payload string")


def test_repair_truncates_from_the_first_conflict(spark):
    local, leader = entries(spark, [(1, 1, "a"), (2, 1, "b"), (3, 2, "c")]), entries(spark, [(1, 1, "a"), (2, 3, "x")])
    out = replication.repair(local, leader, 1).orderBy("index").collect()
    assert [(r["index"], r["term"], r["source"], r["violation"]) for r in out] == [(1, 1, "local", False), (2, 3, "leader", False)]
    assert all(r["violation"] for r in replication.repair(local, leader, 2).collect())
    same = replication.repair(local, local).collect()
    assert len(same) == 3 and {r["source"] for r in same} == {"local"}


def electorate(spark, peers):
    return spark.createDataFrame([(1, p) for p in peers], "leader bigint, peer bigint")


def test_quorum_commit_needs_the_current_term(spark):
    leaders = spark.createDataFrame([(1, 3, 2)], "leader bigint, term bigint, commit bigint")
    p = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (1, 3, 2)], "leader bigint, peer bigint, matched bigint")
    for term, want in ((3, 4), (2, 2)):
        e = spark.createDataFrame([(1, 4, term)], "node bigint, index bigint, term bigint")
        assert replication.quorum_commit(leaders, p, electorate(spark, [1, 2, 3]), e).first()["commit"] == want


@pytest.mark.parametrize("reports, voters, reached", [
    ([(1, 10), (2, 10), (3, None), (4, None), (5, None)], [1, 2, 3, 4, 5], 0),
    ([(1, 10), (2, 10)], [1, 2, 3, 4, 5], 0),
    ([(1, 10), (2, 9), (3, 8)], [1, 2, 3, 4, 5], 8),
    ([(1, 10), (2, 9), (7, 10), (8, 10)], [1, 2, 3, 4], 0),
    ([(1, 10), (2, 9), (2, 11), (2, None), (3, 3)], [1, 2, 3, 4], 3),
    ([], [1, 2, 3], 0),
])
def test_silent_voters_count_and_strangers_do_not(spark, reports, voters, reached):
    rows = spark.createDataFrame([(1, p, v) for p, v in reports], "leader bigint, peer bigint, v bigint")
    who = electorate(spark, voters)
    assert replication.quorum_value(rows, "v", who).first()["q"] == reached
    leaders = spark.createDataFrame([(1, 3, 2, 15)], "leader bigint, term bigint, commit bigint, now bigint")
    entries = spark.range(1, 20).selectExpr("1L as node", "id as index", "3L as term")
    assert replication.quorum_commit(leaders, rows.withColumnRenamed("v", "matched"), who, entries).first()["commit"] == max(2, reached)
    assert replication.lease(leaders, rows.withColumnRenamed("v", "tick"), who).first()["lease_valid"] is (15 - reached < 10)
    pending = spark.createDataFrame([(1, i, i) for i in range(1, 12)], "leader bigint, read_id bigint, ctx bigint")
    assert replication.released_reads(rows.withColumnRenamed("v", "ctx"), pending, who).count() == reached


def test_progress_after_random_events(spark):
    rng = random.Random(5)
    events, model = [], {}
    for step in range(400):
        peer, kind = rng.randrange(3), rng.choice(["sent", "sent", "ok", "ok", "reject", "snapshot", "installed"])
        index, n = (rng.randrange(0, 60) if kind in ("ok", "reject", "installed") else 0), (rng.randrange(1, 9) if kind == "sent" else 0)
        events.append((peer, step * 30_000, kind, index, n))
        m = model.setdefault(peer, {"matched": 0, "next": 1, "inflight": 0, "pending_snapshot": False})
        if kind == "sent":
            m["next"], m["inflight"] = m["next"] + n, m["inflight"] + 1
        elif kind in ("ok", "installed"):
            m["matched"], m["next"] = max(m["matched"], index), max(m["next"], index + 1)
            m["inflight"] = max(0, m["inflight"] - 1) if kind == "ok" else 0
            m["pending_snapshot"] &= kind != "installed"
        elif kind == "reject" and index:
            m["next"], m["inflight"] = max(1, min(index, 41)), 0
        elif kind == "snapshot":
            m["pending_snapshot"] = True
        if step % 57 == 0 or step == 399:
            got = replication.progress_after(spark.createDataFrame(events, "peer bigint, step bigint, kind string, index bigint, n bigint"), 40)
            assert {r["peer"]: {k: r[k] for k in m} for r in got.collect()} == model


def test_conflict_hints_over_runs(spark, monkeypatch):
    monkeypatch.setattr(replication, "RUN", 4)
    terms = [1, 1, 1, 2, 2, 5, 5, 5, 5, 5, 5, 7, 7, 6, 6, 9]
    entries = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(terms)], "node bigint, index bigint, term bigint")
    probes = [(1, i, t) for i in range(1, 20) for t in (1, 5, 9)]
    got = replication.conflict_hint(entries, spark.createDataFrame(probes, "node bigint, prev_index bigint, prev_term bigint"))
    for r in got.collect():
        i, hint = r["prev_index"], None
        if i > len(terms):
            hint = len(terms) + 1
        elif terms[i - 1] != r["prev_term"]:
            hint = i
            while hint > 1 and terms[hint - 2] == terms[i - 1]:
                hint -= 1
        assert r["hint"] == hint


def test_snapshot_of_a_held_prefix_keeps_the_suffix(spark):
    e = spark.createDataFrame([(1, 10, 2), (1, 11, 2)], "node bigint, index bigint, term bigint")
    offers = spark.createDataFrame([(1, 5, 10, 2), (1, 5, 10, 3), (1, 5, 5, 1), (1, 5, 12, 2)], "node bigint, commit bigint, last_index bigint, last_term bigint")
    got = {(r["last_index"], r["last_term"]): r["decision"] for r in replication.snapshot_decisions(offers, e).collect()}
    assert got == {(10, 2): "keep_suffix", (10, 3): "reset", (5, 1): "stale", (12, 2): "reset"}


def test_voters(spark):
    c = spark.createDataFrame([(1, 3, "add", 4), (1, 5, "add", 4), (1, 7, "remove", 1)], "node bigint, index bigint, action string, peer bigint")
    assert replication.voters(c, [1, 2, 3]).first()["voters"] == [2, 3, 4]
    assert replication.voters(c, [1, 2, 3], 5).first()["voters"] == [1, 2, 3, 4]


def test_read_modes(spark):
    log = spark.createDataFrame([(b"a", 1, b"x"), (b"a", 9, b"y")], "key binary, seq bigint, value binary")
    nodes = spark.createDataFrame([(1, "leader", 1, 5, 1, False, True), (2, "follower", 9, 9, 1, True, True)], "node bigint, role string, commit bigint, applied bigint, term bigint, lease_valid boolean, read_confirmed boolean").selectExpr("*", "term as commit_term")
    got = {m: {(r["node"], bytes(r["value"])) for r in reads.read(log, nodes, m).collect()} for m in reads.MODES}
    assert got == {"stale": {(1, b"x"), (2, b"y")}, "lease": set(), "linearizable": {(1, b"x")}}


def test_nearest_rank_percentiles(spark):
    samples = spark.range(1, 101).selectExpr("'k' as kind", "id as micros", "false as failed").orderBy("micros", ascending=False)
    r = metrics.latency_report(samples).first()
    assert (r["p50"], r["p99"], r["mean"]) == (51, 99, 50.5)
    assert metrics.percentile(samples, 1.0).first()[0] == 100
    assert metrics.percentile(samples.where("micros < 0"), 0.5).first()[0] == 0
    assert metrics.mean(samples.where("micros < 0")).first()[0] == 0.0


def test_failover_from_counts(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 10, 5000):
        millis = sorted(rng.randrange(1 + n // 3) for _ in range(n))
        out = metrics.failover(spark.createDataFrame([(x,) for x in [*millis, None]], "millis bigint"))
        assert tuple(out.first()) == (millis[0], millis[(n + 1) // 2 - 1], millis[-1])
        assert "collect_list" not in out._jdf.queryExecution().toString()
    assert tuple(metrics.failover(spark.createDataFrame([], "millis bigint")).first()) == (None, None, None)


def op(invoke, ret, kind, value=None, expect=None, new=None, success=None):
    return {"invoke": invoke, "ret": ret, "op": kind, "value": value, "expect": expect, "new": new, "success": success}


HISTORIES = [
    ([op(0, 1, "write", 1), op(2, 3, "read", 1), op(4, 5, "write", 2), op(6, 7, "read", 2)], True),
    ([op(0, 1, "write", 1), op(2, 3, "write", 2), op(4, 5, "read", 1)], False),
    ([op(0, 1, "write", 1), op(2, 9, "write", 2), op(3, 4, "read", 1)], True),
    ([op(0, 1, "write", 1), op(2, 9, "write", 2), op(3, 4, "read", 2)], True),
    ([op(0, 1, "read", 5), op(2, 3, "write", 5)], False),
    ([op(0, None, "write", 1), op(5, 6, "read", 1)], True),
    ([op(0, None, "write", 1), op(5, 6, "read")], True),
    ([op(0, None, "write", 1), op(5, 6, "read", 1), op(7, 8, "read")], False),
    ([op(0, 1, "write", 1), op(2, 3, "cas", expect=2, new=3, success=True)], False),
    ([op(0, 1, "write", 1), op(2, 9, "cas", expect=1, new=2, success=True), op(2, 9, "cas", expect=1, new=3, success=True)], False),
    ([op(0, 3, "write", 1), op(3, 5, "read")], True),
]


@pytest.mark.parametrize("ops, ok", HISTORIES)
def test_history_cases(ops, ok):
    assert checks.search(ops)[0] is ok


def brute(ops):
    """Try every order of every subset that holds the completed operations."""
    for n in range(len(ops) + 1):
        for chosen in itertools.permutations(range(len(ops)), n):
            rest = [i for i in range(len(ops)) if i not in chosen]
            if any(ops[i]["ret"] is not None for i in rest):
                continue
            value, good = None, True
            for k, i in enumerate(chosen):
                o = ops[i]
                good &= all(ops[j]["ret"] is None or o["invoke"] <= ops[j]["ret"] for j in chosen[k + 1 :])
                if o["op"] == "read":
                    good &= o["ret"] is None or o["value"] == value
                elif o["op"] == "write":
                    value = o["value"]
                else:
                    hit = value == o["expect"]
                    good &= o["success"] is None or o["success"] == hit
                    value = o["new"] if hit else value
                if not good:
                    break
            if good:
                return True
    return False


def test_search_against_all_orders():
    rng = random.Random(3)
    for _ in range(150):
        ops = []
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(8)
            ret = None if rng.random() < 0.2 else a + rng.randrange(1, 5)
            kind = rng.choice(["read", "write", "cas"])
            ops.append(op(a, ret, kind, rng.choice([1, 2]) if kind == "write" else rng.choice([1, 2, None]), rng.choice([1, 2, None]), rng.choice([1, 2]), None if ret is None else rng.random() < 0.5))
        assert checks.search(ops)[0] == brute(ops), ops


def test_search_with_much_concurrency():
    writes = [op(i, 100 + i, "write", i) for i in range(11)]
    assert checks.search([*writes, op(200, 201, "read", 7)])[0]
    assert not checks.search([*writes, op(200, 201, "read", 7), op(202, 203, "read", 8)])[0]
    swaps = [op(0, 1, "write", 0), *[op(2, 90, "cas", expect=i, new=i + 1, success=True) for i in range(30)]]
    assert checks.search([*swaps, op(95, 96, "read", 30)])[0]
    assert checks.search([*swaps, op(95, 96, "read", 29)], 100_000) == (False, "not linearizable")
    assert checks.search([op(5, 4, "write", 1)])[0] is False
    assert checks.search([op(0, 1, "read")] * 4097) == (False, "too many operations: 4097")


def test_linearizable_frame(spark):
    rows = [(k, 0, o["invoke"], o["ret"], o["op"], o["value"], o["expect"], o["new"], o["success"]) for k, (ops, _) in enumerate(HISTORIES) for o in ops]
    rows.append((99, 0, 1, 2, "cas", None, 1, 2, None))
    got = {r["key"]: r["ok"] for r in checks.linearizable(spark.createDataFrame(rows, schema.HISTORY)).collect()}
    assert got == {**{k: ok for k, (_, ok) in enumerate(HISTORIES)}, 99: False}


@pytest.mark.parametrize("big", [2**53, 2**62, -(2**62)])
def test_numbers_beyond_doubles_stay_exact(spark, big):
    absent = op(0, 1, "read")
    cases = [
        ([absent, op(2, 3, "write", big), op(4, 5, "read", big + 1)], False),
        ([absent, op(2, 3, "write", big), op(4, 5, "read", big)], True),
        ([absent, op(2, 3, "write", big), op(4, 5, "cas", expect=big + 1, new=1, success=True)], False),
        ([absent, op(2, 3, "write", big), op(4, 5, "cas", expect=big, new=big + 1, success=True), op(6, 7, "read", big)], False),
        ([absent, op(2, 3, "write", big), op(4, 5, "cas", expect=big, new=big + 1, success=True), op(6, 7, "read", big + 1)], True),
    ]
    if big > 0:  # stamps a nanosecond apart
        cases += [
            ([absent, op(big, big + 1, "write", 1), op(big + 1, big + 2, "read")], True),
            ([absent, op(big, big + 1, "write", 1), op(big + 2, big + 3, "read")], False),
        ]
    rows = [(k, 0, o["invoke"], o["ret"], o["op"], o["value"], o["expect"], o["new"], o["success"]) for k, (ops, _) in enumerate(cases) for o in ops]
    got = {r["key"]: r["ok"] for r in checks.linearizable(spark.createDataFrame(rows, schema.HISTORY)).collect()}
    assert got == {k: ok for k, (_, ok) in enumerate(cases)}


def reference_draw(seed, i):
    m = 2**64
    x = (seed + i * unsigned.GOLDEN) % m
    x = (x ^ (x >> 30)) * unsigned.MIX_1 % m
    x = (x ^ (x >> 27)) * unsigned.MIX_2 % m
    return x ^ (x >> 31)


def test_draws_and_hashes(spark):
    from pyspark.sql import functions as F

    got = spark.range(20).select(unsigned.draw(F.lit(5), F.col("id") + 1).alias("d"), unsigned.fnv1a(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("h")).collect()
    for i, r in enumerate(got):
        assert r["d"] % 2**64 == reference_draw(5, i + 1)
        h = unsigned.FNV_OFFSET
        for b in f"k{i}".encode():
            h = (h ^ b) * unsigned.FNV_PRIME % 2**64
        assert r["h"] % 2**64 == h


def test_zipf_is_skewed_and_in_range(spark):
    from pyspark.sql import functions as F

    zetan = workload.zeta(spark, 10_000)
    assert abs(zetan - sum(1 / i**0.99 for i in range(1, 10_001))) < 1e-9
    r = spark.range(50_000).select(workload.zipf_rank(workload.uniform(F.lit(1), F.col("id") + 1), 10_000, zetan).alias("r"))
    top = r.agg(F.min("r"), F.max("r"), F.avg((F.col("r") < 10).cast("int"))).first()
    assert top[0] == 0 and top[1] < 10_000 and 0.25 < top[2] < 0.35


def test_fault_profiles_are_functions_of_the_seed(spark):
    a = workload.fault_profiles(spark.range(30).selectExpr("id as seed"))
    b = workload.fault_profiles(spark.range(30).selectExpr("id as seed").repartition(3))
    assert checks.differences(a, b).count() == 0


def test_fault_schedule_takes_its_draws_in_order(spark):
    runs = spark.range(40).selectExpr("id as seed", "if(id % 2 = 0, 3, 5) as nodes", "6000 as end_ms", "0.4 as partition", "0.5 as crash")
    rows = workload.fault_schedule(runs.repartition(3)).orderBy("seed", "place").collect()
    by_seed = {k: list(g) for k, g in itertools.groupby(rows, key=lambda r: r["seed"])}
    assert len(by_seed) == 40 and len({tuple(r["time"] for r in g) for g in by_seed.values()}) == 40
    for seed, events in by_seed.items():
        nodes, down = (3 if seed % 2 == 0 else 5), {}
        assert [e["place"] for e in events] == list(range(len(events)))
        first = reference_draw((seed + unsigned.GOLDEN) % 2**64, 1) / (2**64 - 1) < 0.4
        assert (events[0]["event"] == "partition" and events[0]["time"] == 0) == first
        for e in events:
            if e["event"] == "partition":
                assert 0 < len(e["nodes"]) < nodes and 500 <= e["until"] - e["time"] <= 3000
            elif e["event"] == "crash":
                assert down.get(e["nodes"][0], 0) <= e["time"] and 300 <= e["until"] - e["time"] <= 4000
                down[e["nodes"][0]] = e["until"]
        end = events[-1]["time"]
        assert end >= 6000 and [e["event"] for e in events if e["time"] == end][0] == "heal"
        assert {e["nodes"][0] for e in events if e["event"] == "restart"} == {n for n, at in down.items() if at > end}


def test_messages_are_delivered_in_one_python_process(spark):
    from pyspark.sql import functions as F

    sent = [(i, i % 3, i * 7 % 3, i * 2, f"m{i}") for i in range(-40, 2000)]
    messages = spark.createDataFrame([*sent, (2000, 1, 1, None, "late")], "id bigint, sender bigint, receiver bigint, sent bigint, body string").repartition(3)
    blocked = spark.createDataFrame([(0, 0)], "sender bigint, receiver bigint")
    out = workload.deliver(messages, blocked, 0.2, 0.3, (4, 9), 5)

    def draw(place):
        return reference_draw(5, place)

    want = []
    for i, sender, receiver, at, body in [*sent, (2000, 1, 1, None, "late")]:
        if (sender, receiver) == (0, 0) or draw(i * 4 + 1) / (2**64 - 1) < 0.2:
            continue
        for copy in range(2 if draw(i * 4 + 2) / (2**64 - 1) < 0.3 else 1):
            want.append((i, sender, receiver, at, body, copy, None if at is None else at + 4 + draw(i * 4 + 3 + copy) % 6))
    assert sorted(map(tuple, out.select("id", "sender", "receiver", "sent", "body", "copy", "time").collect()), key=str) == sorted(want, key=str)
    assert workload.deliver(messages.limit(0), blocked, 0.2, 0.3, (4, 9)).count() == 0

    def processes(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sum(plan.count(x) for x in ("ArrowEvalPython", "MapInArrow"))

    assert processes(out) == 1
    d = unsigned.draw(F.lit(5), F.col("id"))
    assert processes(messages.select(unsigned.between(d, 3, 8), unsigned.pick(d, ["a", "b"]))) == 1


def test_places_are_numbered_without_one_task_for_all_rows(spark, sf):
    from logweave.functions import order
    from logweave.plans import bench

    rng = random.Random(3)
    data = [(rng.choice([None, rng.randrange(50)]), i, f"e{i}") for i in range(3000)]
    out = order.numbered(spark.createDataFrame(data, "time bigint, seq bigint, event string").repartition(7), ["time", "seq"], "place")
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["place"], r["time"], r["seq"], r["event"]) for r in out.orderBy("place").collect()] == [(i + 1, *r) for i, r in enumerate(want)]
    assert out.columns == ["time", "seq", "event", "place"] and dict(out.dtypes)["place"] == "bigint"
    assert order.numbered(out.drop("place").limit(0), ["time"], "place").count() == 0
    # the only rows that one task sees all of are the counts of the ranges
    plan = bench.QUERIES["event_queue"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 1 and "sum(_n" in windows[0]
