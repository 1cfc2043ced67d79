"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the budget is shared by weight, a source stops at `max_passes` times its size, and the excess is shared
again by weight (water-filling, in closed form over the sources ordered by size per weight). Each source's
documents are shuffled by a keyed hash and laid end to end; the stream, repeated up to max_passes times, is cut
into blocks of `block_tokens`. Golden-ratio points, taken in exact 32-bit fixed point, are mapped through the
cumulative block counts; the slots that fall to a source are ranked and its k-th slot takes its k-th block. Blocks
that the points leave over (a few per source) get the slots that follow; the last block ends at the target. What a
document is taken for is the sum over its scheduled blocks.

Equal rows (source, doc_id, size) are one group with a count until they are laid out. Positions and ranks are prefix
sums over hash buckets of groups or runs of slots first, and within one of them second; the number of buckets follows
from that of groups, so no task holds all rows of a source, nor all copies of a row. `mix` never shuffles texts, `apply`
once. The sources' own table (a row per source) is ordered in one task.

A null text has size 0; documents of size 0 are taken with 0 words. A null source is a source of its own, ordered
last. Rows with equal hashes are ordered by doc_id and size; repeated rows are laid out one after the other, each with
its own words taken. A text of any length is laid over as many blocks as it needs. An empty table gives no rows.
Columns other than doc_id, source and text are not read by `mix`; `apply` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.session import scratch, stored

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT, MAX_PASSES, BLOCK_TOKENS = 150, 2, 2048
#: Groups of a bucket of the shuffled order and copies laid out at once, at most about; slots of a run, cells of the unit
#: interval.
_BUCKET, _COPIES, _RUN, _CELL_BITS = 50_000, 4096, 8192, 10
#: The golden ratio's fraction in 32-bit fixed point; odd, so that 2**32 slots visit each point once.
_GOLDEN = 2654435769


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, weight, target, stop): stop is the target in whole words."""
    cycle = F.array(*map(F.lit, weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("rank", rank)
    s = s.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_passes)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * budget_percent / F.lit(100.0))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    s = s.withColumn("level", F.first(fits, ignorenulls=True).over(everything))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double"))))
    s = s.withColumn("stop", F.least(F.col("cap"), F.floor(F.col("target") + 0.5)).cast("long"))
    return s.select("source", "source_size", "rank", "weight", "target", "stop")


def points(slots: DataFrame) -> Column:
    """The golden-ratio point of each slot, in [0, 2**32), without overflow."""
    low, high = F.col("slot").bitwiseAND(0xFFFF), F.shiftright("slot", 16).bitwiseAND(0xFFFF)
    return (high * _GOLDEN % (1 << 32) * (1 << 16) + low * _GOLDEN) % (1 << 32)


def schedule(sources: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(rank, block, slot): the slots of all blocks, those that the points give first, the others after the last one."""
    spark = sources.sparkSession
    blocks = sources.select("rank", F.ceil(F.col("stop") / block_tokens).cast("long").alias("blocks")).where("blocks > 0")
    order = Window.orderBy("rank")
    blocks = blocks.withColumn("upto", F.sum("blocks").over(order)).withColumn("n", F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    scale = F.lit(float(1 << 32))
    blocks = blocks.withColumn("hi", F.floor(F.col("upto") * scale / F.col("n"))).withColumn("lo", F.floor((F.col("upto") - F.col("blocks")) * scale / F.col("n")))
    wanted, blocks = blocks.select("rank", "blocks"), blocks.where("hi > lo")
    n = sources.agg(F.sum(F.ceil(F.col("stop") / block_tokens).cast("long"))).first()[0] or 0
    slots = spark.range(n).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", points(slots)).withColumn("cell", F.shiftright("point", 32 - _CELL_BITS))
    cell = F.explode(F.sequence(F.shiftright("lo", 32 - _CELL_BITS), F.shiftright(F.col("hi") - 1, 32 - _CELL_BITS)))
    found = slots.join(blocks.select("rank", "blocks", "lo", "hi", cell.alias("cell")), "cell").where("lo <= point and point < hi")
    found = found.select("rank", "blocks", "slot", (F.floor(F.col("slot") / _RUN)).cast("long").alias("run"))
    runs = found.groupBy("rank", "run").agg(F.count(F.lit(1)).alias("k"))
    ahead = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("rank", "run", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot")) - 1
    ranked = found.withColumn("k", inner).join(runs, ["rank", "run"]).withColumn("block", F.col("k") + F.col("ahead"))
    ranked = ranked.where("block < blocks").select("rank", "block", "slot")
    have = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("have"))
    left = wanted.join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < blocks")
    left = left.select("rank", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("block"))
    late = F.lit(n) + F.row_number().over(Window.orderBy("rank", "block")) - 1  # a few blocks for each source
    return ranked.unionByName(left.withColumn("slot", late.cast("long")))


def _laid_out(groups: DataFrame) -> DataFrame:
    """groups (start, size, k, ...) as k rows, one after the other; large groups are dealt out in pieces first."""

    def rows(g: DataFrame, first: Column, end: Column) -> DataFrame:
        return g.withColumn("no", F.explode(F.sequence(first, end))).withColumn("start", F.col("start") + F.col("no") * F.col("size"))

    few = rows(groups.where(F.col("k") <= _COPIES), F.lit(0).cast("long"), F.col("k") - 1)
    many = groups.where(F.col("k") > _COPIES).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / _COPIES))))
    many = rows(many.repartition("digest", "piece"), F.col("piece") * _COPIES, F.least((F.col("piece") + 1) * _COPIES, "k") - 1).drop("piece")
    return few.unionByName(many).drop("no", "k", "digest")


def place(documents: DataFrame, more: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """The documents' places in their source's stream (`start`), and the sources with targets.

    `documents` has doc_id, source, size and the columns `more`, and is read once."""
    same = ["doc_id", "source", "size", *(more or [])]
    groups = stored(documents.groupBy(*same).agg(F.count(F.lit(1)).alias("k")), "mix-groups")
    digits = 3
    while 16**digits * _BUCKET < groups.count():
        digits += 1
    words_of = F.col("size") * F.col("k")
    sizes = groups.groupBy("source").agg(F.sum(words_of).alias("source_size"))
    sources = stored(targets(sizes, **options), "mix-sources")
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = groups.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, digits))
    # all rows without a doc_id have one hash, so their sizes are buckets of their own
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.concat("digest", F.lpad(F.hex("size"), 16, "0"))).otherwise(F.col("bucket")))
    named = [F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("none")]
    sums = d.groupBy("source", "bucket").agg(F.sum(words_of).alias("s"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("s").over(ahead), F.lit(0)))
    at = sums.select(*named, "bucket", "ahead").join(sources.select(*named, "rank", "source_size", "target", "stop"), ["key", "none"])
    inner = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size", *(more or [])).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum(words_of).over(inner), F.lit(0)))
    d = d.select(*same, "k", "digest", "start", *named, "bucket").join(at, ["key", "none", "bucket"])
    d = d.select(*same, "k", "digest", (F.col("start") + F.col("ahead")).alias("start"), "rank", "source_size", "target", "stop")
    return _laid_out(d), sources


def segments(placed: DataFrame, sources: DataFrame, max_passes: int = MAX_PASSES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix itself: which words of which document each slot takes."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1)))
    p = placed.where("size > 0").withColumn("pass", passes).withColumn("from", F.col("start") + F.col("pass") * F.col("source_size")).where("from < stop")
    p = p.withColumn("to", F.least(F.col("from") + F.col("size"), "stop"))
    block = F.explode(F.sequence(F.floor(F.col("from") / block_tokens), F.floor((F.col("to") - 1) / block_tokens)))
    p = p.withColumn("block", block)
    lo, hi = F.greatest("from", F.col("block") * block_tokens), F.least("to", (F.col("block") + 1) * block_tokens)
    p = p.select("doc_id", "source", "size", "start", "rank", "source_size", "target", "block", "pass", (lo - F.col("from")).alias("first_word"), (hi - lo).alias("taken"))
    return p.join(schedule(sources, block_tokens), ["rank", "block"])


def mix(documents: DataFrame) -> DataFrame:
    """One row per document: its source's size and target, the words of it that the mix takes, and its first slot."""
    placed, sources = place(documents.select("doc_id", "source", words(F.col("text")).alias("size")))
    key = ["doc_id", "source", "size", "source_size", "target", "rank", "start"]
    taken = segments(placed, sources).groupBy(*key).agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    # documents without taken words: placed behind the stop, or without words
    rest = placed.where("size = 0 or start >= stop").select(*key, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.unionByName(rest).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def whole(placed: DataFrame, sources: DataFrame, more: list[str], max_passes: int = MAX_PASSES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix in whole documents: the copies (`more`, rank, slot, from) that it takes, with the slots of the blocks in
    which they start. The document across a source's stop is taken if that ends no further from the stop than without."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1)))
    p = placed.where("size > 0").withColumn("pass", passes).withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
    p = p.where(2 * F.col("from") + F.col("size") <= 2 * F.col("stop")).withColumn("block", F.floor(F.col("from") / block_tokens))
    return p.select(*more, "rank", "block", "from").join(schedule(sources, block_tokens), ["rank", "block"]).drop("block")


def apply(documents: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, in the order of the schedule: each copy comes whole, where its
    first word's slot is (copies in one slot as they stand in the source).

    Rows that are equal in all columns share out the copies that fall to them."""
    plain = [c for c, t in documents.dtypes if "map<" not in t and "variant" not in t]
    ids = [F.xxhash64(*plain).alias("id1"), F.xxhash64(F.lit("mix"), *plain).alias("id2")]
    with scratch(documents.sparkSession):
        placed, sources = place(documents.select("doc_id", "source", words(F.col("text")).alias("size"), *ids), ["id1", "id2"])
        taken = stored(whole(placed, sources, ["id1", "id2"]), "mix-copies", keep=True)
        repeated = stored(placed.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id1", "id2"), "mix-repeated", keep=True)
    # the wide rows keep their own columns apart, so that no name can clash
    wide = documents.select(F.struct("*").alias("row"), *ids)
    if not repeated.isEmpty():
        one = wide.join(repeated, ["id1", "id2"], "left_semi").groupBy("id1", "id2").agg(F.first("row").alias("row"))
        wide = wide.join(repeated, ["id1", "id2"], "left_anti").unionByName(one)
    return wide.join(taken, ["id1", "id2"]).orderBy("slot", "rank", "from").select("row.*")
