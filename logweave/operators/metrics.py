"""Latency, throughput and node metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.order import grouped_percentiles

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def latency_report(samples: DataFrame) -> DataFrame:
    """samples (kind, micros, failed) to count, mean and nearest-rank percentiles by kind; failed ones don't count."""
    good = samples.where(~F.col("failed"))
    sums = good.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), (F.sum("micros") / F.count(F.lit(1))).alias("mean"))
    return sums.join(grouped_percentiles(good, "kind", "micros", QUANTILES), "kind")


def throughput(samples: DataFrame, seconds: float) -> DataFrame:
    """One row: operations, errors, operations a second."""
    done = F.count_if(~F.col("failed"))
    return samples.agg(done.alias("ops"), F.count_if("failed").alias("errors"), (done / F.lit(float(seconds))).alias("ops_per_s"))


def timeline(samples: DataFrame, seconds: int = 1) -> DataFrame:
    """(second, ops) for every `seconds` between the first and the last sample, 0 where nothing was done.

    The series is a range cut into pieces of 4,096 steps, so it is made in parallel."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1_000_000 * seconds))
    counts = samples.where("ts is not null").groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("ops"))
    bounds = counts.agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a is not null")
    pieces = bounds.select(F.explode(F.sequence(F.shiftright("a", 12), F.shiftright("b", 12))).alias("piece"), "a", "b").repartition("piece")
    steps = F.sequence(F.greatest(F.col("piece") * 4096, "a"), F.least(F.col("piece") * 4096 + 4095, "b"))
    series = pieces.select(F.explode(steps).alias("at"))
    return series.join(counts, "at", "left").select(F.timestamp_seconds(F.col("at") * seconds).alias("second"), F.coalesce("ops", F.lit(0)).alias("ops"))


def counter_rate(readings: DataFrame, run: int = 1 << 16) -> DataFrame:
    """readings (tick, total) with the difference to the reading before (to 0 for the first). A run of ticks takes the
    last total of the run before, so readings are spread over tasks."""
    r = readings.withColumn("_run", F.floor(F.col("tick") / run))
    ends = r.groupBy("_run").agg(F.max_by("total", "tick").alias("_end"))
    ends = ends.select("_run", F.lag("_end").over(Window.orderBy("_run")).alias("_carried"))
    inner = F.lag("total").over(Window.partitionBy("_run").orderBy("tick"))
    r = r.withColumn("_inner", inner).join(ends, "_run")
    return r.withColumn("done", F.col("total") - F.coalesce("_inner", "_carried", F.lit(0))).drop("_run", "_inner", "_carried")


def failover(trials: DataFrame) -> DataFrame:
    """trials (millis) to smallest, lower median and largest, from counts of equal values; nulls if there are none."""
    counts = trials.where("millis is not null").groupBy("millis").agg(F.count(F.lit(1)).alias("k"))
    ranked = counts.select("millis", F.sum("k").over(Window.orderBy("millis")).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("total"))
    median = F.min(F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), F.col("millis")))
    return ranked.agg(F.min("millis").alias("min_ms"), median.alias("median_ms"), F.max("millis").alias("max_ms"))


def mean(samples: DataFrame) -> DataFrame:
    return samples.agg(F.coalesce(F.avg("micros"), F.lit(0.0)).alias("mean"))


def percentile(samples: DataFrame, q: float) -> DataFrame:
    """The nearest-rank percentile, from counts of equal values; 0 of none."""
    found = grouped_percentiles(samples.select(F.lit(0).alias("all"), "micros"), "all", "micros", {"value": q})
    return found.agg(F.coalesce(F.max("value"), F.lit(0)).alias("value"))


def merged(*partials: DataFrame) -> DataFrame:
    """The samples of several clients together."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out


def counters(requests: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """requests (node, kind, mode, answer) to counters by node; `snapshots` has a row (node) for each one taken.

    A proposal and a linearizable read count once they are accepted (`ok`, or `timeout` if they are told to retry
    later), a lease read when it is served, a stale one always. Refusals count as not_leader or retries, whatever was
    asked; a time-out is a retry, too."""
    c, kind, mode, answer = F.count_if, F.col("kind"), F.col("mode"), F.col("answer")
    accepted = answer.isin("ok", "timeout")
    by_node = requests.groupBy("node").agg(
        c((kind == "write") & accepted).alias("proposals"),
        c((kind == "write") & (answer == "ok")).alias("applied"),
        c((kind == "read") & (mode == "stale")).alias("reads_stale"),
        c((kind == "read") & (mode == "lease") & (answer == "ok")).alias("reads_lease"),
        c((kind == "read") & (mode == "linearizable") & accepted).alias("reads_linearizable"),
        c(answer == "not_leader").alias("not_leader"),
        c(answer.isin("retry", "timeout")).alias("retries"),
    )
    if snapshots is None:
        return by_node
    taken = snapshots.groupBy("node").agg(F.count(F.lit(1)).alias("taken"))
    return by_node.join(taken, "node", "left").withColumn("snapshots", F.coalesce("taken", F.lit(0))).drop("taken")


def gauges(states: DataFrame) -> DataFrame:
    """states (node, tick, role, term, commit, applied): the last ones, with the apply lag (never below 0)."""
    last = states.groupBy("node").agg(F.max_by(F.struct("role", "term", "commit", "applied"), "tick").alias("s"))
    return last.select("node", "s.term", "s.commit", "s.applied", (F.col("s.role") == "leader").cast("int").alias("is_leader"), F.greatest(F.col("s.commit") - F.col("s.applied"), F.lit(0)).alias("lag"))


def exposition(gauges: DataFrame) -> DataFrame:
    """Metrics as text lines, one (node, line) each."""
    named = F.explode(F.array(*[F.concat(F.lit(f"{c}{{node=\""), F.col("node").cast("string"), F.lit("\"} "), F.col(c).cast("string")) for c in ("term", "commit", "applied", "is_leader", "lag")]))
    return gauges.select("node", named.alias("line"))


def report_lines(report: DataFrame, elapsed_s: float, errors: int = 0) -> DataFrame:
    """(place, line): a latency report as text, a total line first, then one line a kind in order of its name."""
    total = report.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(0).alias("place"), F.format_string(f"%d ops in {elapsed_s:.2f}s = %.0f ops/sec ({errors} errors)", "n", F.col("n") / F.lit(float(elapsed_s))).alias("line"))
    head = report.sparkSession.range(1).select(F.lit(1).alias("place"), F.format_string("%-8s" + " %9s" * 6, *map(F.lit, ["op", "count", "mean_us", *(f"{k}_us" for k in QUANTILES)])).alias("line"))
    rank = F.row_number().over(Window.orderBy("kind")) + 1  # a row a kind
    rows = report.select(rank.alias("place"), F.format_string("%-8s %9d %9.0f" + " %9d" * len(QUANTILES), "kind", "n", "mean", *QUANTILES).alias("line"))
    return total.unionByName(head).unionByName(rows)


def sweep(runs: DataFrame) -> DataFrame:
    """runs (seed, ops, events, failed, seconds): totals, the failing seeds and seeds a minute."""
    failing = F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("seed"))))
    return runs.agg(F.count(F.lit(1)).alias("seeds"), F.sum("ops").alias("ops"), F.sum("events").alias("events"), failing.alias("failures"), (F.count(F.lit(1)) * 60 / F.sum("seconds")).alias("seeds_per_min"))
