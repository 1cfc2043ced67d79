"""K-d tree partitioning into shards of nearly equal bytes, in DataFrame operations only.

Equal texts form a unit, described by four metadata coordinates in [0, 1): its size, its source, its language and
its lowest doc_id. Starting from all units, a node that stands for n shards is cut along its widest coordinate at
the weighted quantile n//2 : n - n//2 of its bytes, until every node is one shard of about the target bytes. The
quantile comes from rounds of 4,096-bin histograms, each within the bin that the last one ended in (two as a rule,
more where many units tie), so a level costs a few small aggregations, and the driver sees one bin of each node. Coordinates get a hashed fraction far below
their grid, so that ties (one source may hold a third of all rows) can be cut anywhere.

Groups: equal texts stay together, unless their bytes exceed a quarter of the target; such a group is split by doc_id,
and equal rows by their number, into units of a fiftieth of the target; so one row repeated any number of times is
spread, too. A null text counts as empty (size 16); null metadata has a coordinate of its own. A text of any length is one row
of its size. Repeated rows are rows like all others and get slots of their own, in any order
among themselves. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.session import stored

SHARDS, OVERHEAD = 40, 16
BINS, MAX_ROUNDS = 4096, 4
#: A cut is refined until the bin that it falls into has at most this share of a shard's bytes.
TOLERANCE = 0.002
#: A group above this share of a shard is split, into units of this share.
SPLIT_FROM, SPLIT_INTO = 0.25, 0.02
#: Rows that get their slots in one task, about.
SLOT_ROWS = 100_000
#: Bytes of a file that `write` makes, about.
FILE_BYTES = 512 << 20
_DIMS = 4


def _unit(x: Column) -> Column:
    """A hash as a fraction in [0, 1)."""
    return F.pmod(x, F.lit(1 << 30)) / float(1 << 30)


def _table(values: dict[int, float]) -> Column:
    """A number for each node, as an array of constants."""
    table = np.zeros(max(values, default=0) + 1)
    for k, v in values.items():
        table[k] = v
    return F.lit(table)


def _by_node(values: dict[int, float]) -> Column:
    """The number of a row's node; null for nodes beyond the table."""
    return F.get(_table(values), F.col("node").cast("int"))


def _node(levels: list[tuple[dict[int, int], dict[int, float]]]) -> Column:
    """A unit's node, by the dimension and cut of each node of the levels so far. One fold over the levels: written out,
    each level would stand in the next one three times, and in every filter that the optimiser moves below."""
    if not levels:
        return F.lit(0).cast("long")

    def deeper(node: Column, level: Column) -> Column:
        i = node.cast("int")
        return node * 2 + F.when(F.get("at", F.get(level["dims"], i).cast("int")) >= F.get(level["cuts"], i), 1).otherwise(0)

    steps = F.array(*[F.struct(_table(dims).alias("dims"), _table(cuts).alias("cuts")) for dims, cuts in levels])
    return F.aggregate(steps, F.lit(0).cast("long"), deeper)


def _coordinate(dims: dict[int, int]) -> Column:
    return F.element_at("at", (_by_node(dims) + 1).cast("int"))


def _quantiles(units: DataFrame, nodes: dict[int, dict]) -> dict[int, float]:
    """Where to cut each node along its dimension, so that `left` of its weight lies below."""
    every, nodes = nodes, dict(nodes)
    for _ in range(MAX_ROUNDS):
        nodes = {k: v for k, v in nodes.items() if v.get("in_bin", v["tolerance"] + 1) > v["tolerance"]}
        if not nodes:
            break
        lo, step = (_by_node({k: v[c] for k, v in nodes.items()}) for c in ("lo", "step"))
        inside = units.where(_by_node(dict.fromkeys(nodes, 1)) == 1)
        inside = inside.select("node", "weight", _coordinate({k: v["dim"] for k, v in nodes.items()}).alias("x"), lo.alias("lo"), step.alias("step")).where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("lo") + F.col("step") * BINS))
        cell = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("step")), F.lit(BINS - 1))
        sums = inside.groupBy("node", cell.alias("bin")).agg(F.sum("weight").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        want = _by_node({k: v["want"] for k, v in nodes.items()})
        crossing = sums.withColumn("upto", upto).withColumn("want", want).where("upto >= want and upto - w < want")
        for row in crossing.collect():  # one row per node
            v = nodes[row["node"]]
            start = v["lo"] + v["step"] * row["bin"]
            v["want"] -= row["upto"] - row["w"]
            v["hi"], v["lo"], v["in_bin"] = start + v["step"], start, row["w"]
            v["step"] = max(v["step"] / BINS, 1e-300)
    return {k: v["hi"] if 2 * v["want"] >= v["in_bin"] else v["lo"] for k, v in every.items() if "hi" in v}


def tree(units: DataFrame, shards: int) -> DataFrame:
    """units (with `at`, an array of coordinates, and `weight`) with their shard. A unit's node is worked out from the
    cuts so far in the scan itself, so a level costs its aggregations and nothing of the levels before."""
    levels, sizes, first = [], {0: shards}, {0: 0}
    while any(n > 1 for n in sizes.values()):
        level = units.withColumn("node", _node(levels))
        split = {k for k, n in sizes.items() if n > 1}
        at = [F.element_at("at", i + 1) for i in range(_DIMS)]
        stats = level.groupBy("node").agg(F.sum("weight").alias("w"), *[F.min(a).alias(f"a{i}") for i, a in enumerate(at)], *[F.max(a).alias(f"b{i}") for i, a in enumerate(at)])
        nodes = {}
        for row in stats.collect():  # one row per node
            if row["node"] in split:
                dim = max(range(_DIMS), key=lambda i: row[f"b{i}"] - row[f"a{i}"])
                lo, width = row[f"a{dim}"], row[f"b{dim}"] - row[f"a{dim}"]
                nodes[row["node"]] = {"dim": dim, "lo": lo, "step": max(width, 1e-12) * (1 + 1e-9) / BINS, "want": row["w"] * (sizes[row["node"]] // 2) / sizes[row["node"]], "tolerance": TOLERANCE * row["w"] / sizes[row["node"]]}
        dims = {k: v["dim"] for k, v in nodes.items()}
        cuts = _quantiles(level, nodes)
        # a node that isn't cut, or has no units, keeps all it has on its left, for its shards to have numbers
        levels.append((dict.fromkeys(sizes, 0) | dims, dict.fromkeys(sizes, np.inf) | cuts))
        sizes, first = (
            {c: n for k, s in sizes.items() for c, n in ([(2 * k, s // 2), (2 * k + 1, s - s // 2)] if s > 1 else [(2 * k, 1)])},
            {c: n for k, s in sizes.items() for c, n in ([(2 * k, first[k]), (2 * k + 1, first[k] + s // 2)] if s > 1 else [(2 * k, first[k])])},
        )
    return units.withColumn("node", _node(levels)).withColumn("shard", _by_node(first).cast("int")).drop("node")


def slots(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (with shard, doc_id, h, again) with a slot that counts from 0 in each shard."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", "again"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("k"))
    ahead = F.sum("k").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h", "again")) - 1
    return rows.withColumn("inner", inner).join(counts, ["shard", "bucket"]).withColumn("slot", (F.col("inner") + F.col("ahead")).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `again`, which counts the equal ones (doc_id and text) from 0: in each input partition first."""
    same = ["doc_id", "h", "part"]
    counts = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("k"))
    ahead = F.sum("k").over(Window.partitionBy("doc_id", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("doc_id").alias("doc2"), F.col("h").alias("h2"), F.col("part").alias("part2"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inner = F.row_number().over(Window.partitionBy(*same).orderBy("rid")) - 1
    match = F.col("doc_id").eqNullSafe(F.col("doc2")) & (F.col("h") == F.col("h2")) & (F.col("part") == F.col("part2"))
    return rows.withColumn("inner", inner).join(counts, match).withColumn("again", F.col("inner") + F.col("ahead")).drop("inner", "ahead", "doc2", "h2", "part2")


def _row_id() -> Column:
    return F.monotonically_increasing_id()


def _placed(documents: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """One row per document (rid: its number in this read of the table) with shard and slot; the bytes of all."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    narrow = documents.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64("source").alias("src"), F.xxhash64("lang").alias("lng"), _row_id().alias("rid"), F.spark_partition_id().alias("part"))
    narrow = stored(narrow, "shard-rows")
    key = ["h", "text_crc32", "size"]
    total = narrow.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    target = (total["bytes"] or 0) / shards
    groups = narrow.groupBy(*key).agg(F.sum("size").alias("bytes"))
    hot = groups.where(F.col("bytes") > SPLIT_FROM * target).select(*key, F.ceil(F.col("bytes") / (SPLIT_INTO * max(target, 1.0))).alias("pieces"))
    # at most shards / SPLIT_FROM groups can be that large
    rows = narrow.join(F.broadcast(hot), key, "left")
    many = _numbered(rows.where("pieces is not null"))
    many = many.withColumn("piece", F.pmod(F.xxhash64("doc_id", "again"), F.col("pieces")))
    few = rows.where("pieces is null").withColumn("again", F.lit(0).cast("long")).withColumn("piece", F.lit(0).cast("long"))
    rows = few.unionByName(many).drop("pieces", "part")
    key = [*key, "piece"]
    units = rows.groupBy(*key).agg(F.sum("size").alias("weight"), F.min("doc_id").alias("low"), F.min("src").alias("src"), F.min("lng").alias("lng"))
    span = float((total["b"] or 0) - (total["a"] or 0) + 1)
    low = (F.coalesce("low", F.lit(total["a"] or 0)) - F.lit(total["a"] or 0)) / span
    blur = _unit(F.xxhash64(*key, F.lit("cut"))) / float(1 << 20)
    coordinates = [F.least(F.log2(F.col("size").cast("double")) / 40, F.lit(0.999)), _unit(F.col("src")), _unit(F.col("lng")), low]
    units = units.withColumn("at", F.array(*[c + blur for c in coordinates])).select(*key, "weight", "at")
    units = tree(stored(units, "shard-units"), shards).select(*key, "shard")
    placed = slots(rows.join(units, key), max(1, -(-total["n"] // (shards * SLOT_ROWS)), 8))
    return placed.select("rid", "doc_id", "size", "text_crc32", "shard", "slot"), total["bytes"] or 0


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its size and checksum, the law, its shard and its slot there."""
    placed, _ = _placed(documents, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents under path, in a folder for each shard, with their slots: a file for each `FILE_BYTES` of a shard,
    in the order of the slots. The table is read twice; where its partitions differ between the two, this fails."""
    placed, size = _placed(documents, shards)
    placed = placed.select("rid", F.col("doc_id").alias("shard_doc"), "shard", "slot")
    own = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_doc"), _row_id().alias("rid"))
    files = max(shards, -(-size // FILE_BYTES))
    joined = own.join(placed, "rid", "left").withColumn("shard", F.when(F.col("own_doc").eqNullSafe(F.col("shard_doc")), F.col("shard")).otherwise(F.raise_error(F.lit("the table's partitions changed between two reads; store it first"))))
    joined.select("row", "shard", "slot").repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
