"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch day.

A list is a log of entries (kind, pattern, category, action, day): `add` makes a pattern active from that day on,
`remove` ends it that day; of several entries for a pattern on one day an `add` counts. Kind `domain` matches a host
and all hosts below it, kind `prefix` a host with the leading segments of the path. Captures are exploded into the
domains and prefixes that could match, as many as the host has labels and the path has segments, and joined by
equality on (kind, pattern); intervals then decide. Most candidates (`com`, a host that no list has) are in no list:
where the list has at most `SMALL_LIST` intervals it is broadcast, so captures are not shuffled for this join at all;
beyond that, candidates first pass a bitmap of the list's keys of a fixed size, and only what it lets through is
shuffled. Both ways give the same rows. A listed host with very many captures is split by the adaptive skew join.

A null or unparsable URL has no host and is not blocked; a null fetch day matches nothing. Of several active entries the
longest pattern is told, of equal ones the last by pattern and category. Repeated captures get equal results; a URL of
any length gives as many candidates as it has labels and segments. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.session import stored

#: Intervals of a list that is broadcast, at most (some tens of MB).
SMALL_LIST = 200_000
#: Bits of the bitmap that candidates pass first if the list is larger: 8 MB.
BITMAP_BITS = 26


def host(url: Column) -> Column:
    """The lower-case host without user, port and trailing dot; null if there is none."""
    found = F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("."))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, valid_from, valid_to): valid_to is exclusive, null while the entry stands."""
    per_day = entries.where("pattern is not null and day is not null").groupBy("kind", "pattern", "category", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    order = Window.partitionBy("kind", "pattern", "category").orderBy("day")
    return per_day.withColumn("valid_to", F.lead("day").over(order)).where("on = 1").select("kind", "pattern", "category", F.col("day").alias("valid_from"), "valid_to")


def candidates(captures: DataFrame) -> DataFrame:
    """captures (url, host, day) with one row for each domain and prefix that could match."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    parts = F.filter(F.split(path(F.col("url")), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern")))
    prefixes = F.when(F.size(parts) > 0, prefixes).otherwise(F.slice(domains, 1, 0))
    return captures.where("host is not null").withColumn("key", F.explode(F.concat(domains, prefixes))).select("url", "host", "day", "key.kind", "key.pattern")


def _slot() -> Column:
    return F.shiftrightunsigned(F.xxhash64("kind", "pattern"), 64 - BITMAP_BITS)


def may_be_listed(found: DataFrame, listed: DataFrame) -> DataFrame:
    """The candidates (kind, pattern, ...) whose key may be one of the list's; no listed one is lost.

    The bitmap is put together from 64-bit words, so the driver gets at most 2 ** (BITMAP_BITS - 6) of them."""
    slot = _slot()
    words = listed.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = found.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        i = at.to_numpy()
        return pd.Series((shared.value[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0)

    return found.where(known(slot))


def screen(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, blocked, the number of active entries, and the longest active pattern."""
    base = captures.select("page_id", "url", "day", host(F.col("url")).alias("host"))
    listed = stored(intervals(entries), "url-intervals")
    found = candidates(base.select("url", "host", "day").where("day is not null"))
    if listed.count() <= SMALL_LIST:
        listed = F.broadcast(listed)
    else:
        found = may_be_listed(found, listed)
    active = found.join(listed, ["kind", "pattern"]).where("valid_from <= day and (valid_to is null or day < valid_to)")
    active = active.dropDuplicates(["url", "day", "kind", "pattern", "category"])
    best = F.struct(F.length("pattern").alias("n"), "pattern", "category")
    found = active.groupBy("url", "day").agg(F.count(F.lit(1)).alias("n_active"), F.max(best).alias("best"))
    joined = base.join(found.withColumnRenamed("url", "url2").withColumnRenamed("day", "day2"), (F.col("url") == F.col("url2")) & (F.col("day") == F.col("day2")), "left")
    return joined.select("page_id", "host", F.col("day").alias("fetch_day"), F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.pattern").alias("pattern"), F.col("best.category").alias("category"))
