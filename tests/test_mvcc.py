import random

from pyspark.sql import functions as F

from logweave.api import Store
from logweave.operators import maintenance, metrics, mvcc
from logweave.sources import fixtures


def rows(df):
    return [tuple(bytes(x).decode() if isinstance(x, (bytes, bytearray)) else x for x in r) for r in df.collect()]


def test_versions_tombstones_and_missing_keys(spark):
    log = mvcc.literal_log(spark, [("a", 1, "v1"), ("a", 3, "v3"), ("a", 5, None)])
    outcome = {s: rows(mvcc.get(log, b"a", s))[0][1:] for s in (1, 2, 4, 5, 100)}
    assert outcome == {1: ("live", "v1"), 2: ("live", "v1"), 4: ("live", "v3"), 5: ("tombstone", None), 100: ("tombstone", None)}
    assert rows(mvcc.get(log, b"b"))[0][1:] == ("missing", None)
    assert rows(mvcc.get(log, b"a", 0))[0][1:] == ("missing", None)


def test_empty_value_is_alive(spark):
    log = mvcc.literal_log(spark, [("a", 1, ""), ("b", 2, None)])
    assert rows(mvcc.scan(log)) == [("a", "")]


def test_merge_and_visibility(spark):
    left = mvcc.literal_log(spark, [("a", 5, "5"), ("c", 2, "2")])
    right = mvcc.literal_log(spark, [("a", 3, "3"), ("b", 4, "4"), ("a", 5, "5")])
    assert [r[:2] for r in rows(mvcc.versions(mvcc.merge(left, right)))] == [("a", 5), ("a", 3), ("b", 4), ("c", 2)]
    log = mvcc.literal_log(spark, [("a", 5, "5"), ("a", 3, "3"), ("b", 9, None), ("b", 4, "4")])
    assert sorted(rows(mvcc.visible(log, 4))) == [("a", 3, "3"), ("b", 4, "4")]
    assert sorted(rows(mvcc.visible(log))) == [("a", 5, "5"), ("b", 9, None)]


def test_scan_bounds_and_limits(spark):
    log = mvcc.literal_log(spark, [(f"k{i:03d}", i + 1, str(i)) for i in range(100)])
    assert [r[0] for r in rows(mvcc.scan(log, b"k010", b"k020"))] == [f"k{i:03d}" for i in range(10, 20)]
    assert len(rows(mvcc.scan(log, b"k050", limit=5))) == 5
    assert rows(mvcc.scan(log, limit=0)) == []


def test_random_operations_against_a_dictionary(spark):
    rng, ops, model, at = random.Random(7), [], {}, {}
    for seq in range(1, 601):
        key = f"key{rng.randrange(30):03d}"
        value = None if rng.random() < 0.25 else str(rng.randrange(1000))
        ops.append((key, seq, value))
        model[key] = value
        if seq % 150 == 0:
            at[seq] = {k: v for k, v in model.items() if v is not None}
    log = mvcc.literal_log(spark, ops).cache()
    for seq, want in at.items():
        assert dict(rows(mvcc.scan(log, snapshot=seq))) == want
    for bottom in (False, True):
        kept = mvcc.collect_garbage(log, 300, bottom).cache()
        for seq in (300, 450, 600):
            assert dict(rows(mvcc.scan(kept, snapshot=seq))) == at[seq]
        assert kept.count() < log.count()


def test_batches_and_replacement(spark):
    log = mvcc.append(mvcc.literal_log(spark, [("a", 1, "x"), ("b", 2, "y")]), [(b"a", b"1"), (b"a", b"2")], 3)
    assert dict(rows(mvcc.scan(log))) == {"a": "2", "b": "y"}
    assert mvcc.append(log, [], 9) is log
    new = mvcc.literal_log(spark, [("c", 0, "z")]).select("key", "value")
    assert dict(rows(mvcc.scan(mvcc.replace_all(log, new, 10)))) == {"c": "z"}


def test_replacement_comes_after_a_longer_log(spark):
    log = mvcc.literal_log(spark, [("a", 1, "x"), ("b", 10, "y"), ("c", 25, "z"), ("d", 30, "w")])
    new = mvcc.literal_log(spark, [("a", 0, "1"), ("c", 0, "2")]).select("key", "value")
    for seq, want in ((10, 31), (30, 31), (31, 31), (40, 40)):
        out = mvcc.replace_all(log, new, seq).cache()
        assert dict(rows(mvcc.scan(out))) == {"a": "1", "c": "2"}
        assert sorted(rows(mvcc.scan(out, snapshot=30))) == sorted(rows(mvcc.scan(log)))
        assert {r["seq"] for r in out.where("seq > 30").collect()} == {want} and out.count() == 8
    empty = mvcc.replace_all(log.limit(0), new, 3)
    assert {r["seq"] for r in empty.collect()} == {3} and empty.columns == log.columns


def test_horizon(spark):
    log = mvcc.literal_log(spark, [("a", 1, "x"), ("a", 7, "y")])
    pins = spark.createDataFrame([(3,), (5,)], "seq bigint")
    assert mvcc.horizon(log, pins).first()[0] == 3
    assert mvcc.horizon(log, pins.where("seq > 9")).first()[0] == 7


def test_wal_prefix_stops_at_the_first_bad_frame(spark):
    ops = [(b"k", b"v")]
    frames = spark.createDataFrame([(i, i + 1, ops, i != 3) for i in range(6)], "frame bigint, first_seq bigint, ops array<struct<key: binary, value: binary>>, valid boolean")
    assert sorted(r["frame"] for r in maintenance.valid_prefix(frames).collect()) == [0, 1, 2]
    assert maintenance.replay(frames).count() == 3
    assert maintenance.valid_prefix(frames.where("valid")).count() == 5


def test_filters_never_deny_a_member(spark):
    keys = spark.range(1000).selectExpr("0 as part", "cast(cast(id as string) as binary) as key")
    others = spark.range(1000, 3000).selectExpr("0 as part", "cast(cast(id as string) as binary) as key")
    filters = maintenance.bloom(keys, "part").cache()
    assert maintenance.bloom_probe(keys, filters, "part").where("not may_contain").count() == 0
    assert maintenance.bloom_probe(others, filters, "part").where("may_contain").count() < 100


def test_compaction_keeps_a_key_in_one_table(spark):
    log = mvcc.literal_log(spark, [(f"user{i % 40:012d}", i + 1, "x" * 50) for i in range(400)])
    out = maintenance.compact([log.where("seq <= 300"), log.where("seq > 250")], 0, False, 2000)
    assert out.count() == 400
    assert out.groupBy("key").agg({"table": "min"}).count() == 40
    assert out.select("key", "table").distinct().count() == 40
    assert out.select("table").distinct().count() > 3


def test_store(spark, tmp_path):
    store = Store.create(spark, f"{tmp_path}/log")
    assert store.seq() == 0 and store.get("a") is None
    assert store.write([("a", "1"), ("b", "2"), ("a", "3")]) == 3
    pin = store.seq()
    store.delete("b")
    assert store.cas("a", "3", "4") == (True, b"3")
    assert store.cas("a", "3", "5") == (False, b"4")
    assert store.cas("z", None, None) == (True, None)
    assert rows(store.scan(snapshot=pin)) == [("a", "3"), ("b", "2")]
    assert rows(store.scan()) == [("a", "4")]
    small = store.compact(f"{tmp_path}/small", [pin], 2)
    assert rows(small.scan(snapshot=pin)) == [("a", "3"), ("b", "2")] and rows(small.scan()) == [("a", "4")]


def test_scan_plan_pushes_bounds_and_limits_groups(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    mvcc.literal_log(spark, [(f"k{i % 50:03d}", i + 1, str(i)) for i in range(500)]).write.parquet(f"{tmp_path}/log")
    log = Store(spark, f"{tmp_path}/log").log()
    plan = mvcc.scan(log, b"k010", b"k020", 5, 400)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("WindowGroupLimit") >= 2
    assert "LessThanOrEqual(seq,400)" in plan and "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    kept = mvcc.collect_garbage(log, 300)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,300)" in kept and "LessThanOrEqual(seq,300)" in kept and "WindowGroupLimit" in kept
    keys = mvcc.visible(log).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:binary,seq:bigint>" in keys


def test_regression_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# seeds\n\n6 # first\n  19519\n")
    assert sorted(r["seed"] for r in fixtures.seeds(spark, f"{tmp_path}/seeds.txt").collect()) == [6, 19519]


def greedy(sizes, target):
    """The table of each key, one after the other."""
    out, table, held = [], 0, 0
    for b in sizes:
        if held >= target:
            table, held = table + 1, 0
        held += b
        out.append(table)
    return out


def test_tables_are_cut_like_one_after_the_other(spark):
    rng = random.Random(9)
    for sizes, target in (([63] * 12, 200), ([rng.randrange(1, 300) for _ in range(700)], 500), ([rng.choice([5, 4000]) for _ in range(300)], 900), ([10] * 50, 10**6), ([7], 1), ([100] * 40, 1)):
        keys = spark.createDataFrame([(f"k{i:05d}".encode(), b) for i, b in enumerate(sizes)], "key binary, b bigint").repartition(3)
        got = [r["table"] for r in maintenance.cut_tables(keys, target).orderBy("key").collect()]
        assert got == greedy(sizes, target)
    assert maintenance.cut_tables(keys.where("b < 0"), 10).count() == 0


def test_settled_levels_hold_the_same(spark):
    rng = random.Random(2)
    log = [(f"k{rng.randrange(60):03d}", i + 1, None if rng.random() < 0.2 else "v" * rng.randrange(30)) for i in range(900)]
    versions = mvcc.literal_log(spark, log).selectExpr("0 as level", "floor((seq - 1) / 100) as id", "*")
    out = maintenance.settle(versions, 500, 4, 3, 6_000, 3, 2_000).cache()
    due = maintenance.compaction_due(maintenance.catalog(out), 4, 3, 6_000, 3)
    assert due.where("due and level < 3").count() == 0
    for seq in (500, 700, 900):
        assert sorted(rows(mvcc.dump(out.select("key", "seq", "value"), seq))) == sorted(rows(mvcc.dump(mvcc.literal_log(spark, log), seq)))
    tables = maintenance.catalog(out).where("level > 0")
    pairs = tables.alias("a").join(tables.alias("b"), on=[F.expr("a.level = b.level and a.id < b.id and a.max_key >= b.min_key and a.min_key <= b.max_key")])
    assert pairs.count() == 0


def test_a_level_is_settled_in_one_round(spark, monkeypatch):
    rng = random.Random(4)
    log = [(f"k{rng.randrange(300):03d}", i + 1, None if rng.random() < 0.2 else "v" * rng.randrange(30)) for i in range(1200)]
    versions = mvcc.literal_log(spark, log).selectExpr("cast(floor((seq - 1) / 20) % 3 as int) as level", "floor((seq - 1) / 20) as id", "*")
    rounds, compact = [], maintenance.compact
    monkeypatch.setattr(maintenance, "compact", lambda *a: rounds.append(1) or compact(*a))
    # 40 tables and more have to leave level 1; numbers below those that are taken are not given again
    out = maintenance.settle(versions, 500, 4, 4, 1_000, 4, 500, 5).cache()
    assert len(rounds) <= 3
    assert maintenance.compaction_due(maintenance.catalog(out), 4, 4, 1_000, 4).where("due and level < 3").count() == 0
    for seq in (500, 800, 1200):
        assert sorted(rows(mvcc.dump(out.select("key", "seq", "value"), seq))) == sorted(rows(mvcc.dump(mvcc.literal_log(spark, log), seq)))
    assert maintenance.catalog(out).where("level > 0 and id < 60 and level < 3").count() == 0


def test_tables_leave_a_level_by_id_until_enough_bytes_are_gone(spark):
    rng = random.Random(8)
    sizes = [rng.randrange(1, 100) for _ in range(50)]
    tables = spark.createDataFrame([(1, 7 * i, b) for i, b in enumerate(sizes)], "level int, id bigint, bytes bigint").repartition(3)
    for excess in (1, sizes[0], sizes[0] + 1, 900, sum(sizes)):
        left, want = 0, []
        for i, b in enumerate(sizes):
            if left >= excess:
                break
            want.append(7 * i)
            left += b
        assert [r["id"] for r in maintenance.leaving(tables, excess).orderBy("id").collect()] == want


def test_written_tables_serve_point_and_range_reads(spark, tmp_path):
    log = mvcc.literal_log(spark, [(f"k{i % 400:04d}", i + 1, str(i)) for i in range(4000)])
    maintenance.write_tables(log, f"{tmp_path}/tables", 8)
    table = spark.read.schema(log.schema).parquet(f"{tmp_path}/tables")
    assert rows(mvcc.get(table, b"k0123", 2000)) == rows(mvcc.get(log, b"k0123", 2000))
    assert rows(mvcc.get(table, b"none"))[0][1] == "missing"
    assert rows(mvcc.scan(table, b"k0100", b"k0120", 7, 3000)) == rows(mvcc.scan(log, b"k0100", b"k0120", 7, 3000))
    plan = mvcc.get(table, b"k0123", 2000)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(seq), IsNotNull(key), LessThanOrEqual(seq,2000), EqualTo(key" in plan
    # a file's keys are a range, so statistics leave one or two files for a key
    ranges = table.groupBy(F.input_file_name()).agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <= binary('k0123') and b >= binary('k0123')")
    assert ranges.count() <= 2


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(6)

    def some(n):
        spans = [sorted((rng.randrange(500), min(499, rng.randrange(500)))) for _ in range(n)]
        return [(i, f"{a:03d}".encode(), f"{b:03d}".encode()) for i, (a, b) in enumerate(spans)]

    schema = "id bigint, min_key binary, max_key binary"
    left, right = some(40), some(60)
    got = maintenance.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    assert sorted((r["input_id"], r["id"]) for r in got) == sorted((a, b) for a, al, ah in left for b, bl, bh in right if bh >= al and bl <= ah)


def test_flush_point_and_rates(spark):
    log = mvcc.literal_log(spark, [(f"k{i % 9}", 1000 * i + 1, "x" * (i % 50)) for i in range(9000)]).cache()
    total, point = 0, None
    for r in log.orderBy("seq").collect():
        total += len(r["key"]) + len(r["value"]) + 24
        point = point or (r["seq"] if total >= 300_000 else None)
    assert maintenance.flush_point(log, 300_000).first()[0] == point
    assert maintenance.flush_point(log, 10**9).first()[0] is None
    readings = spark.createDataFrame([(t, t * t) for t in range(1, 50)], "tick bigint, total bigint")
    assert [r["done"] for r in metrics.counter_rate(readings, 8).orderBy("tick").collect()] == [t * t - (t - 1) ** 2 for t in range(1, 50)]
    stamps = spark.sql("SELECT timestamp'2024-01-01 23:59:50' + make_interval(0, 0, 0, 0, 0, 0, id * id) AS ts FROM range(200)")
    got = [(r["second"].hour * 3600 + r["second"].minute * 60 + r["second"].second, r["ops"]) for r in metrics.timeline(stamps).orderBy("second").collect()]
    assert len(got) == 199 * 199 + 1 and sum(n for _, n in got) == 200 and {i for i, (_, n) in enumerate(got) if n} == {i * i for i in range(200)}


def test_pins_are_counted(spark):
    events = spark.createDataFrame([(5, 1), (5, 1), (5, -1), (9, 1), (9, -1)], "seq bigint, delta int")
    assert [r["seq"] for r in mvcc.pinned(events).collect()] == [5]
