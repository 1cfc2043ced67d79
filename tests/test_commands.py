import random

from logweave import schema
from logweave.operators import commands
from logweave.streaming import apply as streaming


def log(spark, rows):
    """(session, seq, op, key, value, expect, new) in order."""
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], schema.COMMANDS)


def results(df):
    return {r["log_index"]: (r["status"], r["result"], r["success"], r["actual"]) for r in df.collect()}


def test_duplicates_get_the_first_answer_and_old_ones_are_stale(spark):
    c = log(spark, [(1, 1, "cas", "k", None, None, "a"), (1, 1, "cas", "k", None, None, "a"), (2, 5, "put", "k", "b", None, None), (2, 3, "put", "k", "c", None, None), (2, 6, "cas", "k", None, "x", "y")])
    out, state = commands.apply(c)
    got = results(out)
    assert got[1] == ("applied", "cas", True, None) and got[2] == ("duplicate", "cas", True, None)
    assert got[4] == ("stale", "stale", None, None)
    assert got[5] == ("applied", "cas", False, "b")
    assert [tuple(r) for r in state.collect()] == [("k", "b")]
    assert commands.responses(out).where("error is not null").count() == 1


def test_session_zero_has_no_deduplication(spark):
    c = log(spark, [(0, 1, "get", "k", None, None, None), (0, 1, "get", "k", None, None, None), (0, 0, "put", "k", "v", None, None)])
    assert {r["status"] for r in commands.statuses(c).collect()} == {"applied"}
    assert [r["log_index"] for r in commands.validated(c).where("error is not null").collect()] == [3]
    assert commands.sessions(c).count() == 0


def model(rows, base=None):
    kv, last, answers, out = dict(base or {}), {}, {}, {}
    for i, (s, seq, op, key, value, expect, new) in enumerate(rows, 1):
        if s and s in last and seq <= last[s]:
            out[i] = ("duplicate", *answers[s]) if seq == last[s] else ("stale", "stale", None, None)
            continue
        now = kv.get(key)
        if op == "cas":
            r = ("cas", now == expect, now)
            after = new if now == expect else now
        else:
            r = ("value", None, now) if op == "get" else ("ok", None, None)
            after = {"put": value, "delete": None, "get": now}[op]
        kv.pop(key, None)
        if after is not None:
            kv[key] = after
        last[s], answers[s] = seq, r
        out[i] = ("applied", *r)
    return out, kv


def random_rows(seed, n=400):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["a", "b", None])
    return [(rng.randrange(6), rng.randrange(1, 3 + i // 12), rng.choice(["put", "delete", "cas", "cas", "cas", "get"]), f"k{rng.randrange(5)}", rng.choice("ab"), pick(), pick()) for i in range(n)]


def test_random_logs_against_a_model(spark):
    for seed in range(3):
        rows = random_rows(seed)
        out, state = commands.apply(log(spark, rows))
        want, kv = model(rows)
        assert results(out) == want
        assert {r["key"]: r["value"] for r in state.collect()} == kv


def test_runs_of_a_hot_key_and_session_are_chained(spark):
    rng = random.Random(8)
    some = lambda: rng.choice(["a", "b", "c", "d", "e", None])
    swaps = [(1, rng.randrange(1, 3 + i), "cas", "k", None, some(), some()) for i in range(500)]
    resets = [(1, i + 1, rng.choice(["put", "delete"]) if rng.random() < 0.03 else "cas", "k", some() or "x", some(), some()) for i in range(500)]
    for rows, run, base in ((swaps, 3, {"k": "c"}), (resets, 40, None), (random_rows(11), 7, {"k": "c"})):
        frame = base and spark.createDataFrame(list(base.items()), "key string, value string")
        out, state = commands.apply(log(spark, rows), frame, run)
        want, kv = model(rows, base)
        assert results(out) == want
        assert {r["key"]: r["value"] for r in state.collect()} == kv


def test_restore_goes_on_from_an_image(spark):
    rows = [(0, 1, "cas", "k", None, "a", "b"), (0, 1, "get", "k", None, None, None)]
    base = spark.createDataFrame([("k", "a"), ("l", "z")], "key string, value string")
    out, state = commands.fold(log(spark, rows), base)
    assert {r["log_index"]: r["actual"] for r in out.collect()} == {1: "a", 2: "b"}
    assert {r["key"]: r["value"] for r in state.collect()} == {"k": "b", "l": "z"}
    a = commands.image(state, commands.sessions(log(spark, rows))).first()
    assert a["keys"] == 2 and a["sessions"] == 0


def test_stream_equals_batch_over_several_runs(spark, tmp_path):
    rows = random_rows(9, 120)
    c = log(spark, rows)
    want = {(r["log_index"], r["status"]) for r in commands.statuses(c).collect()}
    source = f"{tmp_path}/in"
    for lo, hi in ((0, 50), (50, 120)):
        c.where(f"log_index > {lo} and log_index <= {hi}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.COMMANDS).parquet(source)
        streaming.write_statuses(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["log_index"], r["status"]) for r in got} == want and len(got) == 120
