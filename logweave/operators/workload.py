"""Workload and fault-profile generation: every value is a function of a seed and a position, so rows are made in
parallel from a range and can be made again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave import schema
from logweave.functions import unsigned

# The share of the first kind in each mix, and the kinds.
MIXES = {"A": (0.5, "read", "update"), "B": (0.95, "read", "update"), "C": (1.0, "read", "read"), "D": (0.95, "read", "insert"), "E": (0.95, "scan", "insert"), "F": (0.5, "read", "rmw")}
# What a fault profile picks from.
NODES, DROPS, DUPLICATES = [3, 3, 3, 5], [0.0, 0.02, 0.10, 0.20], [0.0, 0.05]
DELAY_MIN_MS, DELAY_MAX_MS, PARTITIONS, CRASHES = 1, (3, 25), [0.0, 0.15, 0.30], [0.0, 0.10, 0.20]
CLIENTS, KEYS, RUN_MS, QUIET_MS, SNAPSHOT_AFTER = 3, 4, 20_000, 8_000, 60
SIM_READ, SIM_WRITE = 0.4, 0.4


def key_of(i: Column) -> Column:
    return F.format_string("user%012d", i)


def zeta(spark: SparkSession, n: int, theta: float = schema.ZIPF_THETA) -> float:
    """The sum of 1 / i**theta for i to n; partial sums are added in order, so it doesn't depend on the cluster."""
    part = F.floor((F.col("id") - 1) / 65536)
    parts = spark.range(1, n + 1).groupBy(part.alias("p")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sums = parts.select("p", F.aggregate("ids", F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.pow(i.cast("double"), F.lit(theta))).alias("s"))
    return float(sum(r["s"] for r in sums.orderBy("p").collect()))  # a number for each 65,536 ranks


def zipf_rank(u: Column, n: int, zetan: float, theta: float = schema.ZIPF_THETA) -> Column:
    """Ranks in [0, n) from uniform doubles, small ranks hot."""
    alpha, zeta2 = 1 / (1 - theta), 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta2 / zetan)
    tail = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - F.lit(eta) + 1, F.lit(alpha)))
    return F.when(u * zetan < 1, 0).when(u * zetan < 1 + 0.5**theta, 1).otherwise(tail).cast("bigint")


def uniform(seed: Column, position: Column) -> Column:
    return unsigned.unit(unsigned.draw(seed, position))


def mix(u: Column, name: str) -> Column:
    share, first, second = MIXES[name.upper()]
    return F.when(u < share, first).otherwise(second)


def operations(spark: SparkSession, name: str, n: int, keys: int, seed: int = 1, inserted: int = 0) -> DataFrame:
    """(op_index, kind, key, scan_length) of a run. Hot ranks are scrambled over the keyspace; workload D reads
    uniformly among the last inserted keys; scans have 1 to 100 rows and no end."""
    zetan = zeta(spark, keys)
    s, i = F.lit(seed).cast("bigint"), F.col("id") * 3
    rows = spark.range(n).select(F.col("id").alias("op_index"), mix(uniform(s, i + 1), name).alias("kind"), unsigned.draw(s, i + 2).alias("d"), unsigned.draw(s, i + 3).alias("e"))
    rank = zipf_rank(unsigned.unit(F.col("d")), keys, zetan)
    have = keys + inserted
    recent = F.lit(have - 1) - unsigned.below(F.col("d"), min(schema.RECENT_INSERTS, have))
    index = recent if name.upper() == "D" else unsigned.scramble(rank, keys)
    index = F.when(F.col("kind") == "insert", F.lit(have) + F.col("op_index")).otherwise(index)
    return rows.select("op_index", "kind", key_of(index).alias("key"), F.when(F.col("kind") == "scan", unsigned.below(F.col("e"), schema.SCAN_LENGTH) + 1).alias("scan_length"))


def load_ranges(spark: SparkSession, keys: int, clients: int) -> DataFrame:
    """(client, first, end) of the loading phase: contiguous ranges of keys // clients + 1."""
    per = keys // clients + 1
    c = F.col("id")
    return spark.range(clients).select(c.alias("client"), F.least(c * per, F.lit(keys)).alias("first"), F.least((c + 1) * per, F.lit(keys)).alias("end"))


def issued(ops: int, clients: int) -> int:
    """Operations that a run really issues: the remainder of ops / clients is dropped."""
    return ops // clients * clients


def run_plan(spark: SparkSession, name: str, ops: int, clients: int, keys: int, seed: int = 1) -> DataFrame:
    """(client, op_index, kind, key, scan_length) of a run: each client issues as many operations as the others, one
    after the other."""
    per = max(ops // clients, 1)
    rows = operations(spark, name, issued(ops, clients), keys, seed)
    return rows.select(F.floor(F.col("op_index") / per).alias("client"), (F.col("op_index") % per).alias("op_index"), "kind", "key", "scan_length")


def values(rows: DataFrame, length: int = 100, seed: int = 7) -> DataFrame:
    """rows (i, ...) with `value`: 8-byte little-endian draws, cut to length."""
    per = -(-length // 8)

    @F.pandas_udf("binary")
    def run(i: pd.Series) -> pd.Series:
        at = i.to_numpy()[:, None] * per + np.arange(1, per + 1)[None, :]
        x = unsigned.draws(np.full(at.shape, seed, dtype=np.uint64), at)
        return pd.Series([r.astype("<u8").tobytes()[:length] for r in x])

    return rows.withColumn("value", run("i"))


def read_modify_write(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """reads (id, key, seen) and the values in place when the swap arrives (key, value): a lost race is done, too."""
    return reads.join(writes, "key", "left").select("id", "key", F.col("seen").eqNullSafe(F.col("value")).alias("won"), F.lit(True).alias("done"))


def fault_profiles(seeds: DataFrame) -> DataFrame:
    """(seed, ...) to a row with the whole fault profile. The generator starts one step in, and each pick is a draw."""
    names = "seed bigint, nodes int, msg_drop double, msg_dup double, max_delay_ms bigint, partition_prob double, crash_prob double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            state = (pdf["seed"].to_numpy().view(np.uint64) ^ np.uint64(unsigned.PROFILE_SEED)) + np.uint64(unsigned.GOLDEN)

            def choose(position: int, options: list, state=state) -> np.ndarray:
                return np.array(options)[(unsigned.draws(state, position) % np.uint64(len(options))).astype(np.int64)]

            lo, hi = DELAY_MAX_MS
            delay = lo + (unsigned.draws(state, 4) % np.uint64(hi - lo + 1)).astype(np.int64)
            yield pd.DataFrame({"seed": pdf["seed"], "nodes": choose(1, NODES), "msg_drop": choose(2, DROPS), "msg_dup": choose(3, DUPLICATES), "max_delay_ms": delay, "partition_prob": choose(5, PARTITIONS), "crash_prob": choose(6, CRASHES)})

    out = seeds.select(F.col("seed").cast("bigint").alias("seed")).mapInPandas(run, names)
    fixed = {"clients": CLIENTS, "keys": KEYS, "run_ms": RUN_MS, "quiet_ms": QUIET_MS, "min_delay_ms": DELAY_MIN_MS, "snapshot_every": SNAPSHOT_AFTER}
    return out.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])


def client_operations(rows: DataFrame, seed: int = 3) -> DataFrame:
    """rows (i) with kind (40% read, 40% write, 20% swap) and one of four keys."""
    s = F.lit(seed).cast("bigint")
    u = uniform(s, F.col("i") * 2 + 1)
    return rows.withColumn("kind", F.when(u < SIM_READ, "read").when(u < SIM_READ + SIM_WRITE, "write").otherwise("cas")).withColumn("key", unsigned.below(unsigned.draw(s, F.col("i") * 2 + 2), KEYS))


def deliver(messages: DataFrame, blocked: DataFrame, drop: float, duplicate: float, delay_ms: tuple[int, int], seed: int = 5) -> DataFrame:
    """messages (id, sender, receiver, sent) as delivered: blocked links and drops take some, duplicates come twice, each
    copy with a delay of its own; ordered by (time, id, copy) they are the event queue.

    All draws are made in one pass over Arrow batches, so a task has one Python process, not one for each draw."""
    lo, hi = delay_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column("id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            kept = ~unsigned.below_share(unsigned.draws(seed, i * 4 + 1), drop)
            batch, i = batch.filter(pa.array(kept)), i[kept]
            times = 1 + unsigned.below_share(unsigned.draws(seed, i * 4 + 2), duplicate).astype(np.int64)
            at = np.repeat(np.arange(len(i)), times)
            copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            delay = (unsigned.draws(seed, i[at] * 4 + 3 + copy) % np.uint64(hi - lo + 1)).astype(np.int64) + lo
            batch = batch.take(pa.array(at))
            time = pc.add(batch.column("sent").cast(pa.int64()), pa.array(delay))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copy.astype(np.int32)), time], names=[*batch.schema.names, "copy", "time"])

    wanted = messages.join(blocked, ["sender", "receiver"], "left_anti")
    return wanted.mapInArrow(run, T.StructType([*wanted.schema.fields, T.StructField("copy", T.IntegerType()), T.StructField("time", T.LongType())]))


def event_queue(*events: DataFrame) -> DataFrame:
    """Events (time, seq, ...) of several sources in the order in which they happen: by time, then as they were put in."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out.orderBy("time", "seq")


# How long a fault step, a partition and a crash last, in milliseconds; what restarts all at the end.
FAULT_STEP, PARTITION_MS, DOWN_MS, RESTART_MS, ASYMMETRIC = (300, 800), (500, 3000), (300, 4000), (10, 50), 0.3
_FAULT = pa.schema([("seed", pa.int64()), ("place", pa.int32()), ("time", pa.int64()), ("event", pa.string()), ("nodes", pa.list_(pa.int32())), ("asymmetric", pa.bool_()), ("until", pa.int64())])


class _Draws:
    """The generator's numbers for a seed, one after the other."""

    def __init__(self, seed: int):
        self.state, self.place, self.block = (seed + unsigned.GOLDEN) % 2**64, 0, np.zeros(0, dtype=np.uint64)

    def next(self) -> int:
        if self.place % 1024 == 0:
            self.block = unsigned.draws(np.full(1024, self.state, dtype=np.uint64), np.arange(self.place + 1, self.place + 1025))
        self.place += 1
        return int(self.block[(self.place - 1) % 1024])

    def chance(self, p: float) -> bool:
        return float(self.next()) / float(2**64 - 1) < p

    def between(self, bounds: tuple[int, int]) -> int:
        return bounds[0] + self.next() % (bounds[1] - bounds[0] + 1)


def _faults(seed: int, nodes: int, end: int, partition: float, crash: float) -> Iterator[dict[str, Any]]:
    draws, now, up_at = _Draws(seed), 0, dict.fromkeys(range(1, nodes + 1), 0)
    while now < end:
        if draws.chance(partition):
            ids = list(up_at)
            for i in range(nodes - 1, 0, -1):
                j = draws.next() % (i + 1)
                ids[i], ids[j] = ids[j], ids[i]
            side = ids[: draws.between((1, nodes - 1))]
            one_way = draws.chance(ASYMMETRIC)
            yield {"time": now, "event": "partition", "nodes": sorted(side), "asymmetric": one_way, "until": now + draws.between(PARTITION_MS)}
        if draws.chance(crash):
            node = draws.between((1, nodes))
            if up_at[node] <= now:
                up_at[node] = now + draws.between(DOWN_MS)
                yield {"time": now, "event": "crash", "nodes": [node], "asymmetric": None, "until": up_at[node]}
        now += draws.between(FAULT_STEP)
    yield {"time": now, "event": "heal", "nodes": [], "asymmetric": None, "until": None}
    for node, at in up_at.items():
        if at > now:
            yield {"time": now, "event": "restart", "nodes": [node], "asymmetric": None, "until": now + draws.between(RESTART_MS)}


def fault_schedule(runs: DataFrame) -> DataFrame:
    """runs (seed, nodes, end_ms, partition, crash) to (seed, place, time, event, nodes, asymmetric, until).

    Every 300 to 800 ms, until end_ms, a partition may begin (its one side, whether only one way is blocked, and when it
    heals) and a node that is up may crash (and when it restarts). The first step after that heals all links, and
    restarts the nodes that are down still. A seed's draws are taken in that order from one generator; seeds are
    independent, so they are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [{"seed": row["seed"], "place": i, **e} for i, e in enumerate(_faults(row["seed"], row["nodes"], row["end_ms"], row["partition"], row["crash"]))]
                yield pa.RecordBatch.from_pylist(found, _FAULT)

    wanted = runs.select(F.col("seed").cast("bigint").alias("seed"), F.col("nodes").cast("int").alias("nodes"), F.col("end_ms").cast("bigint").alias("end_ms"), F.col("partition").cast("double").alias("partition"), F.col("crash").cast("double").alias("crash"))
    return wanted.mapInArrow(run, "seed bigint, place int, time bigint, event string, nodes array<int>, asymmetric boolean, until bigint")


def backoff(tries: DataFrame, base_ms: int, cap_ms: int) -> DataFrame:
    """tries (attempt, fraction) with window_ms (doubling, at most six times, up to the cap) and the wait."""
    window = F.least(F.lit(base_ms) * F.pow(F.lit(2), F.least("attempt", F.lit(schema.BACKOFF_MAX_SHIFT))), F.lit(cap_ms))
    return tries.withColumn("window_ms", window.cast("bigint")).withColumn("wait_ms", F.col("window_ms") * F.greatest("fraction", F.lit(schema.BACKOFF_MIN_FRACTION)))


def encode_value(v: Column) -> Column:
    """A number as 8 little-endian bytes."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(v), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))


def decode_value(b: Column) -> Column:
    """The number in up to 8 little-endian bytes; missing ones are zero."""
    h = F.rpad(F.hex(b), 16, "0")
    return F.conv(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("bigint")
