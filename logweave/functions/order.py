"""Order statistics with the engine's own rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.shared import stored


def kth_largest(values: Column, k: Column) -> Column:
    """The k-th largest (from 1) of an array; null if it is shorter."""
    return F.when(F.size(values) >= k, F.element_at(F.sort_array(values, False), k.cast("int")))


def quorum(n: Column) -> Column:
    return F.floor(n / 2).cast("int") + 1


def grouped_percentiles(df: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles of each group, without collecting one: equal values are counted first, and the
    value that a rank falls on is found from cumulative counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("k").over(Window.partitionBy(group))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    at = {name: F.floor((F.col("total") - 1) * F.lit(q) + 0.5) for name, q in quantiles.items()}
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("upto") > a, F.col(value))).alias(name) for name, a in at.items()])


def running_sums(rows: DataFrame, by: list[str], at: str, values: dict[str, Column], run: int = 1 << 16) -> DataFrame:
    """rows with inclusive running sums within `by`, in the order of the whole number `at`; nulls count as 0.

    Runs of `run` positions are summed first, so one key's rows are spread over as many tasks as it has runs. Equal
    positions share a sum."""
    step = F.floor(F.col(at) / run)
    rows = rows.withColumn("_run", step).withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()})
    totals = rows.groupBy(*by, "_run").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    ahead = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_run").alias("_at"), *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_a_{k}") for k in values])
    inner = Window.partitionBy(*by, "_run").orderBy(at)
    rows = rows.withColumns({f"_i_{k}": F.sum(f"_v_{k}").over(inner) for k in values})
    same = F.col("_run") == F.col("_at")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    rows = rows.join(totals, same).withColumns({k: F.col(f"_i_{k}") + F.col(f"_a_{k}") for k in values})
    return rows.drop("_run", "_at", *[f"_by_{b}" for b in by], *[f"_{x}_{k}" for x in "vai" for k in values])


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with their place from 1 in the order of `by`.

    They are sorted in ranges and stored once with their place in their range; the rows before each range are added to
    that. Only a row for each range, of which there are as many as shuffle partitions at most, is in one task."""
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(rows.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside + 1).drop("_at", "_range", "_before")
