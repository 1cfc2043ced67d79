"""Storage maintenance as queries over the log, a table catalog and write-ahead frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import schema
from logweave.functions import order, unsigned
from logweave.operators import mvcc
from logweave.shared import partitions, stored


def entry_bytes() -> Column:
    return F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + schema.ENTRY_OVERHEAD_BYTES


def memory(log: DataFrame, budget: int = schema.MEMTABLE_BYTES) -> DataFrame:
    """One row: bytes in memory and whether a flush is due."""
    return log.agg(F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("bytes")).withColumn("flush", F.col("bytes") >= budget)


def flush_point(log: DataFrame, budget: int) -> DataFrame:
    """One row (seq): the first version with which the table in memory is full; null if it never is.

    Sums of long runs of versions come first, then sums of short runs within the one that crosses the budget, and only
    the short run that crosses it is looked at version by version: at most a few thousand rows are ever in one task for
    logs of up to 10**11 versions, and a row for each 2**24 versions beyond."""
    inside = log.select("seq", entry_bytes().alias("b"))
    one = log.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("before"))
    for run in (1 << 24, 1 << 12, 1):
        sums = inside.groupBy(F.floor(F.col("seq") / run).alias("run")).agg(F.sum("b").alias("b"))
        upto = F.sum("b").over(Window.orderBy("run")) + F.col("before")
        full = sums.join(F.broadcast(one)).withColumn("upto", upto).where(F.col("upto") >= budget)
        first = full.agg(F.min(F.struct("run", (F.col("upto") - F.col("b")).alias("before"))).alias("x"))
        one = first.select(F.col("x.run").alias("first"), F.col("x.before").alias("before"))
        inside = inside.join(F.broadcast(one.select("first")), F.floor(F.col("seq") / run) == F.col("first")).drop("first")
    return one.select(F.col("first").alias("seq"))


def valid_prefix(frames: DataFrame) -> DataFrame:
    """The frames before the first bad one; later frames are dropped though they may be valid."""
    bad = frames.where(~F.coalesce("valid", F.lit(False))).agg(F.min("frame").alias("bad"))
    return frames.join(F.broadcast(bad)).where("bad is null or frame < bad").drop("bad")  # one row


def framed(frames: DataFrame, cap: int = schema.FRAME_CAP_BYTES) -> DataFrame:
    """frames (length, crc, data) with `valid`: a length within the cap that the data has, and a checksum that holds."""
    ok = (F.col("length") <= cap) & (F.octet_length("data") == F.col("length")) & (F.crc32("data") == F.col("crc"))
    return frames.withColumn("valid", F.coalesce(ok, F.lit(False)))


def replay(frames: DataFrame) -> DataFrame:
    """The versions of the valid prefix, with their sequence numbers derived again."""
    return mvcc.number_batches(valid_prefix(frames))


def recover(tables: DataFrame, frames: DataFrame) -> DataFrame:
    """All versions after opening: tables and replayed frames, overlaps once."""
    return mvcc.merge(tables, replay(frames))


def opened(manifest_seq: int, frames: DataFrame, budget: int = schema.MEMTABLE_BYTES) -> DataFrame:
    """One row with the state after opening: the last sequence number (of the manifest or the valid frames, whichever
    is greater), the bytes replayed into memory, and whether they are flushed right away."""
    held = replay(frames).agg(F.greatest(F.lit(manifest_seq).cast("bigint"), F.coalesce(F.max("seq"), F.lit(0))).alias("last_seq"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).cast("bigint").alias("bytes"))
    return held.withColumn("flush", F.col("bytes") >= budget)


# The log store's keys. Entries are `e/` and a big-endian index; `0` is the byte after `/`.
ENTRY_PREFIX, ENTRY_END, HARD_STATE_KEY, SNAPSHOT_KEY = b"e/", b"e0", b"m/hs", b"m/snap"


def entry_key(index: Column) -> Column:
    """The key of a log entry; byte order is index order."""
    return F.concat(F.lit(ENTRY_PREFIX), F.unhex(F.lpad(F.hex(index), 16, "0")))


def stored_entries(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(index, value) of the log entries in a store that keeps other keys, too: a range scan of their prefix."""
    rows = mvcc.live(mvcc.visible(mvcc.in_range(log, ENTRY_PREFIX, ENTRY_END), snapshot))
    index = F.conv(F.hex(F.substring("key", len(ENTRY_PREFIX) + 1, 8)), 16, -10).cast("bigint")
    return rows.select(index.alias("index"), "value")


def first_valid(candidates: DataFrame) -> DataFrame:
    """The first valid of an ordered list of manifest candidates (place, valid, ...)."""
    return candidates.where("valid").orderBy("place").limit(1)


def with_checksum(blocks: DataFrame) -> DataFrame:
    """blocks (data, crc) with whether the checksum holds; damaged blocks are told, not served."""
    return blocks.withColumn("intact", F.crc32("data") == F.col("crc"))


def table_stats(log: DataFrame, table: Column) -> DataFrame:
    """Entries, bytes, smallest and largest key, and last sequence number by table."""
    return log.groupBy(table.alias("id")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("entries"), F.sum(entry_bytes()).alias("bytes"), F.max("seq").alias("max_seq"))


def level_counts(catalog: DataFrame, levels: int) -> DataFrame:
    """(level, tables, bytes) of all levels, empty ones too."""
    every = catalog.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    found = catalog.groupBy("level").agg(F.count(F.lit(1)).alias("tables"), F.sum("bytes").alias("bytes"))
    return every.join(found, "level", "left").select("level", F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def level_limit(base: int = schema.LEVEL_BASE_BYTES, multiplier: int = schema.LEVEL_MULTIPLIER) -> Column:
    return (base * F.pow(F.lit(multiplier), F.greatest(F.col("level") - 1, F.lit(0)))).cast("bigint")


def compaction_due(catalog: DataFrame, levels: int, trigger: int = schema.LEVEL0_TRIGGER, base: int = schema.LEVEL_BASE_BYTES, multiplier: int = schema.LEVEL_MULTIPLIER) -> DataFrame:
    """Level 0 is due by its number of tables, deeper ones by their bytes."""
    counts = level_counts(catalog, levels).withColumn("byte_limit", level_limit(base, multiplier))
    return counts.withColumn("due", F.when(F.col("level") == 0, F.col("tables") >= trigger).otherwise(F.col("bytes") > F.col("byte_limit")))


def compaction_sources(catalog: DataFrame) -> DataFrame:
    """The tables that a compaction of each level takes: all of level 0, the lowest id elsewhere."""
    low = F.min("id").over(Window.partitionBy("level"))
    return catalog.withColumn("_low", low).where("level = 0 or id = _low").drop("_low")


def leaving(tables: DataFrame, excess: int) -> DataFrame:
    """The tables of one level that compactions of its lowest id, one after the other, take until `excess` bytes are
    gone: those before which fewer left. What a level gives away doesn't depend on the level below."""
    summed = order.running_sums(tables, ["level"], "id", {"upto": F.col("bytes")})
    return summed.where(F.col("upto") - F.col("bytes") < excess).drop("upto")


#: Cells of the key space in which overlaps are looked for.
CELLS = 1024


def overlaps(inputs: DataFrame, tables: DataFrame) -> DataFrame:
    """(input_id, id): tables whose key range meets an input's range.

    Ranges are cut at the lower bounds of up to CELLS tables, chosen by hash, and meet in the cells they share; a pair
    counts in the first of these. So tables far apart are never compared."""
    some = tables.orderBy(F.xxhash64("id"), "id").limit(CELLS).agg(F.array_sort(F.collect_set("min_key")).alias("cuts"))

    def cells(catalog: DataFrame, *names: str) -> DataFrame:
        c = catalog.select(F.col("id").alias(names[0]), F.col("min_key").alias(names[1]), F.col("max_key").alias(names[2])).join(F.broadcast(some))
        first, last = F.size(F.filter("cuts", lambda x: x <= F.col(names[1]))), F.size(F.filter("cuts", lambda x: x <= F.col(names[2])))
        return c.withColumn(names[3], first).withColumn("cell", F.explode(F.sequence(first, last))).drop("cuts")

    a, b = cells(inputs, "input_id", "lo", "hi", "a"), cells(tables, "id", "min_key", "max_key", "b")
    pairs = b.join(a, "cell").where("max_key >= lo and min_key <= hi and cell = greatest(a, b)")
    return pairs.select("input_id", "id")


#: Bytes that an entry counts beside its key and value where output tables are cut (a fixed value).
CUT_OVERHEAD = 17


def _reactions(target: int):
    """Of each range of keys (part, key, b): what it does to the bytes `a` of the table that is open at its start.

    From a >= a_from on, `cuts` tables begin in the range, and the last of them holds `left` bytes at its end; below the
    first a_from none does."""

    def run(table: pa.Table) -> pa.Table:
        b = table.sort_by("key")["b"].to_numpy()
        at = np.concatenate(([0], np.cumsum(b)))
        total, at = int(at[-1]), at[:-1]
        following = np.searchsorted(at, at + target)
        first = np.arange(min(int(np.searchsorted(at, target)) + 1, len(b)))
        last, cuts = first.copy(), np.ones(len(first), dtype=np.int64)
        moving = np.flatnonzero(following[last] < len(b))
        while len(moving):
            last[moving] = following[last[moving]]
            cuts[moving] += 1
            moving = moving[following[last[moving]] < len(b)]
        left = total - at[last]
        # a_from falls along the keys; of equal reactions in a row the lowest a_from is kept
        same = np.concatenate(((cuts[1:] == cuts[:-1]) & (left[1:] == left[:-1]), [False]))
        part = table["part"][0].as_py()
        rows = {"part": [part] * int((~same).sum() + 1), "a_from": [None, *(target - at[first])[~same].tolist()], "cuts": [0, *cuts[~same].tolist()], "left": [total, *left[~same].tolist()]}
        return pa.Table.from_pydict(rows, pa.schema([("part", pa.int32()), ("a_from", pa.int64()), ("cuts", pa.int64()), ("left", pa.int64())]))

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, a, begun): the open bytes and the tables begun before each range; rows come by part and a_from."""
    part, a, begun, after = None, 0, 0, (0, 0)
    for batch in batches:
        out = []
        for p, a_from, cuts, left in zip(*(batch[c].to_pylist() for c in ("part", "a_from", "cuts", "left"))):
            if p != part:
                a, begun, part = after[0], begun + after[1], p
                out.append((p, a, begun))
            if a_from is None:
                after = (a + left, 0)
            elif a >= a_from:
                after = (left, cuts)
        if out:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64()))], names=["part", "a", "begun"])


def _assign(target: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        b, a, begun = table["b"].to_numpy(), table["a"][0].as_py(), table["begun"][0].as_py()
        at = np.concatenate(([0], np.cumsum(b)))[:-1]
        begins, i = np.zeros(len(b), dtype=np.int64), int(np.searchsorted(at, target - a))
        while i < len(b):
            begins[i] = 1
            i = int(np.searchsorted(at, at[i] + target))
        return pa.table({"key": table["key"], "table": pa.array(begun + np.cumsum(begins))})

    return run


def cut_tables(keys: DataFrame, target_bytes: int) -> DataFrame:
    """(key, table) of keys (key, b): a table ends before the first key at which it has target_bytes; the next counts
    from 0 again. Keys are distinct, so a key's versions never straddle two tables.

    Where a table begins depends on the one before. So each range of keys first tells how it reacts to whatever is
    open at its start (only its first target_bytes matter for that); these reactions, a small share of the keys, are
    walked through in order by one task, and all ranges are then cut in parallel."""
    spark = keys.sparkSession
    ordered = keys.select("key", F.col("b").cast("bigint").alias("b")).repartitionByRange(partitions(spark), "key").withColumn("part", F.spark_partition_id())
    ordered = stored(ordered, "compact-keys")
    reactions = ordered.groupBy("part").applyInArrow(_reactions(target_bytes), "part int, a_from bigint, cuts bigint, left bigint")
    entries = reactions.repartition(1).sortWithinPartitions("part", F.col("a_from").asc_nulls_first()).mapInArrow(_walk, "part int, a bigint, begun bigint")
    kinds = dict(keys.dtypes)
    return ordered.join(entries, "part").groupBy("part").applyInArrow(_assign(target_bytes), f"key {kinds['key']}, table bigint")


def compact(sources: list[DataFrame], horizon: int, bottom: bool, target_bytes: int = schema.TABLE_BYTES) -> DataFrame:
    """The merged versions that a compaction keeps, with the number of the output table (see `cut_tables`)."""
    kept = mvcc.collect_garbage(mvcc.merge(*sources), horizon, bottom)
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + CUT_OVERHEAD
    return kept.join(cut_tables(kept.groupBy("key").agg(F.sum(size).alias("b")), target_bytes), "key")


def catalog(versions: DataFrame) -> DataFrame:
    """The table catalog of versions (level, id, key, seq, value)."""
    size = F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + CUT_OVERHEAD)
    return versions.groupBy("level", "id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("entries"), size.cast("bigint").alias("bytes"))


def settle(versions: DataFrame, horizon: int, levels: int, trigger: int = schema.LEVEL0_TRIGGER, base: int = schema.LEVEL_BASE_BYTES, multiplier: int = schema.LEVEL_MULTIPLIER, target_bytes: int = schema.TABLE_BYTES, next_id: int | None = None) -> DataFrame:
    """versions (level, id, key, seq, value) after compactions until none is due; `levels` levels, the last never due.

    Each round takes the first due level and brings it to its limit: all of level 0, elsewhere the lowest ids that have
    to go, in one merge with the tables of the level below that meet their key range. So there is a round a level at
    most, whatever the number of tables. From the same state a level keeps the tables that one table a round would
    leave; those below are cut once instead of once for each, so their bounds and numbers may differ from that. The
    driver sees one row a level. At the bottom, where all deeper levels are empty, tombstones at or below the horizon
    go."""
    versions = stored(versions.select("level", "id", "key", "seq", "value"), "settle")
    while True:
        tables = stored(catalog(versions), "settle-catalog")
        state = {r["level"]: r for r in compaction_due(tables, levels, trigger, base, multiplier).collect()}
        due = [i for i in range(levels - 1) if state[i]["due"]]
        if not due:
            return versions
        level = due[0]
        next_id = max(next_id or 0, tables.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0])
        sources = tables.where(F.col("level") == level)
        if level:
            sources = leaving(sources, state[level]["bytes"] - state[level]["byte_limit"])
        sources = sources.select("id", "min_key", "max_key")
        span = sources.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
        below = tables.where(F.col("level") == level + 1).join(F.broadcast(span)).where("max_key >= lo and min_key <= hi").select("level", "id")
        taken = stored(sources.select(F.lit(level).alias("level"), "id").unionByName(below), "settle-taken")
        bottom = all(state[i]["tables"] == 0 for i in range(level + 2, levels))
        inputs = versions.join(taken, ["level", "id"], "left_semi").select("key", "seq", "value")
        out = compact([inputs], horizon, bottom, target_bytes).select(F.lit(level + 1).alias("level"), (F.col("table") + next_id).alias("id"), "key", "seq", "value")
        versions = stored(versions.join(taken, ["level", "id"], "left_anti").unionByName(out), "settle")


def write_tables(log: DataFrame, path: str, files: int) -> None:
    """Sorted, key-clustered Parquet files whose row-group statistics and filters serve range and point reads."""
    log.repartitionByRange(files, "key").sortWithinPartitions("key", F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def bloom_shape(keys: Column, bits_per_key: int = schema.BLOOM_BITS_PER_KEY) -> tuple[Column, int]:
    """Bits (whole bytes, 64 at least) and probes of a filter for a number of keys."""
    probes = min(max(int(bits_per_key * schema.BLOOM_LN2), 1), schema.BLOOM_MAX_PROBES)
    return (F.floor((F.greatest(keys * bits_per_key, F.lit(schema.BLOOM_MIN_BITS)) + 7) / 8) * 8).cast("bigint"), probes


def bloom_positions(keys: DataFrame, bits: Column, probes: int) -> DataFrame:
    """keys (key, ...) with the bit positions that a filter of `bits` bits probes: h1 + i * h2, h2 odd."""
    @F.pandas_udf("array<bigint>")
    def run(h1: pd.Series, n: pd.Series) -> pd.Series:
        a = h1.to_numpy().view(np.uint64)
        b = unsigned.finalise(a) | np.uint64(1)
        grid = (a[:, None] + np.arange(probes, dtype=np.uint64)[None, :] * b[:, None]) % n.to_numpy().view(np.uint64)[:, None]
        return pd.Series(list(grid.astype(np.int64)))

    return keys.withColumn("positions", run(unsigned.fnv1a(F.col("key")), bits.cast("bigint")))


def bloom(keys: DataFrame, group: str, bits_per_key: int = schema.BLOOM_BITS_PER_KEY) -> DataFrame:
    """(group, bits, word, mask): the filter over each group's distinct keys, as the 64-bit words that have a bit."""
    distinct = keys.select(group, "key").distinct()
    sizes = distinct.groupBy(group).agg(F.count(F.lit(1)).alias("keys"))
    n, probes = bloom_shape(F.col("keys"), bits_per_key)
    rows = bloom_positions(distinct.join(sizes.withColumn("bits", n).drop("keys"), group), F.col("bits"), probes)
    bits = rows.select(group, "bits", F.explode("positions").alias("p"))
    return bits.groupBy(group, "bits", F.shiftright("p", 6).alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("mask"))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % 64).cast("int"))


def bloom_probe(probes: DataFrame, filters: DataFrame, group: str, bits_per_key: int = schema.BLOOM_BITS_PER_KEY) -> DataFrame:
    """probes (group, key) with may_contain: no key of a filter is ever denied; without a filter nothing is contained.

    Each probed bit meets its word by equality on (group, word), so no row carries a filter."""
    _, k = bloom_shape(F.lit(1), bits_per_key)
    asked = probes.select(group, "key").distinct()
    rows = bloom_positions(asked.join(filters.select(group, "bits").distinct(), group), F.col("bits"), k)
    bits = rows.select(group, "key", F.explode("positions").alias("p")).withColumn("word", F.shiftright("p", 6))
    met = bits.join(filters.select(group, "word", "mask"), [group, "word"], "left")
    hit = F.coalesce(F.col("mask").bitwiseAND(_bit(F.col("p"))) != 0, F.lit(False))
    found = met.groupBy(group, "key").agg(F.min(hit).alias("may_contain"))
    return probes.select(group, "key").join(found, [group, "key"], "left").select(group, "key", F.coalesce("may_contain", F.lit(False)).alias("may_contain"))
