import random

from pyspark.sql import functions as F

from logweave.operators import commands, mvcc
from logweave.streaming import apply as streaming
from logweave.streaming import ordered


def micro_batches(spark, rows, schema, size, query, path):
    """What a streaming query gives of rows that come in batches of `size`, restarted from its checkpoint after each."""
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = query(spark.readStream.schema(schema).parquet(f"{path}/in"))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()))


def test_late_and_repeated_deliveries_are_decided_in_log_order(spark, tmp_path):
    rng, schema = random.Random(4), "log_index bigint, session_id bigint, client_seq bigint"
    rows = [(i, rng.randrange(4), rng.randrange(1 + i // 8)) for i in range(240)]
    sent = [(r, r[0] + rng.randrange(15)) for r in rows for _ in range(1 + (rng.random() < 0.3))]
    sent = [r for r, _ in sorted(sent, key=lambda x: x[1])]
    assert sent != sorted(sent)
    got = micro_batches(spark, sent, schema, 110, lambda s: ordered.in_order(s, 20), tmp_path)
    want = commands.statuses(spark.createDataFrame(rows, schema)).select("log_index", "session_id", "client_seq", "status").collect()
    assert got == sorted(tuple(r) for r in want if r["log_index"] < 220)


def test_operations_without_an_end_are_told_to_retry(spark, tmp_path):
    ops = [(i, "begin", i * 3) for i in range(40)] + [(i, "end", i * 3 + (4 if i % 3 == 1 else 30)) for i in range(40) if i % 3] + [(999, "begin", 1000)]
    got = micro_batches(spark, sorted(ops, key=lambda x: x[2]), "id bigint, kind string, tick bigint", 40, lambda s: ordered.deadlines(s, 20, 5), tmp_path)
    assert got == [(i, "ok", i * 3 + 4) if i % 3 == 1 else (i, "retry", i * 3 + 20) for i in range(40)]


def test_appended_mutations_read_like_the_log(spark, tmp_path):
    log = mvcc.literal_log(spark, [(f"k{i % 7}", i + 1, None if i % 5 == 0 else str(i)) for i in range(60)])
    for lo, hi in ((0, 25), (25, 60)):
        log.where((F.col("seq") > lo) & (F.col("seq") <= hi)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
        streaming.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    table = spark.read.parquet(f"{tmp_path}/log")
    assert table.count() == 60
    assert sorted(map(tuple, mvcc.dump(table).collect())) == sorted(map(tuple, mvcc.dump(log).collect()))


def test_windowed_counts_over_untimed_zone_stamps(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id as int) / 2) AS ts, if(id % 3 = 0, 'a', 'b') AS kind FROM range(40)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = streaming.windowed_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["second"].minute * 60 + r["second"].second, r["kind"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the last stamp is 19.5 s, the watermark 10 s behind it: the windows up to second 8 are closed
    want = {}
    for i in range(18):
        key = (i // 2, "a" if i % 3 == 0 else "b")
        want[key] = want.get(key, 0) + 1
    assert got == want
