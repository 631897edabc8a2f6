"""Stream latency, throughput and detection delay per run.

Input: one row per scored snapshot with ``run``, ``seq`` (arrival order),
``num_edges``, ``elapsed`` (seconds) and optionally ``span`` (seconds of data
time in the snapshot, null when unknown).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.operators.ordering import group_position, group_quantiles, running, shifted
from tgraph.session import materialize

# Fixed values of the profile.
WARMUP_MIN = 5
WARMUP_FRACTION = 0.1
MIN_AFTER_WARMUP = 20


def after_warmup(
    log: DataFrame,
    by: Sequence[str] = ("run",),
    warmup_min: int = WARMUP_MIN,
    warmup_fraction: float = WARMUP_FRACTION,
) -> DataFrame:
    """Number each run's snapshots and flag those past the warm-up.

    The warm-up of n snapshots is ``min(n, max(warmup_min, ceil(fraction*n)))``.
    """
    by = list(by)
    placed = group_position(log, by, ["seq"], "_rn")
    sizes = log.groupBy(*by).agg(F.count("*").alias("_n"))
    share = F.ceil(F.col("_n") * F.lit(warmup_fraction)).cast("bigint")
    warm = F.least(F.col("_n"), F.greatest(F.lit(warmup_min).cast("bigint"), share))
    return (
        placed.join(sizes.withColumn("warmup", warm), by)
        .withColumn("measured", F.col("_rn") > F.col("warmup"))
        .drop("_rn")
        .withColumnRenamed("_n", "snapshots")
    )


def latency_profile(
    log: DataFrame,
    by: Sequence[str] = ("run",),
    warmup_min: int = WARMUP_MIN,
    warmup_fraction: float = WARMUP_FRACTION,
    min_after: int = MIN_AFTER_WARMUP,
) -> DataFrame:
    """Warm-up-excluded throughput and latency of each run, in one row."""
    by = list(by)
    rows = materialize(after_warmup(log, by, warmup_min, warmup_fraction), "latency")
    used = rows.filter("measured").withColumn("_ms", F.col("elapsed") * F.lit(1000.0))
    percentiles = group_quantiles(
        used, by, "_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}
    )
    ok = F.col("measured")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(ok, c)), F.lit(0))

    seconds = total(F.col("elapsed")).cast("double")
    edges = total(F.col("num_edges")).cast("bigint")
    measured = F.count_if(ok)
    out = rows.groupBy(*by).agg(
        F.max("warmup").alias("warmup_snapshots"),
        measured.alias("snapshots_after_warmup"),
        edges.alias("edges_after_warmup"),
        seconds.alias("elapsed_after_warmup_sec"),
        F.when(seconds > 0, edges / seconds).otherwise(F.lit(0.0)).alias(
            "throughput_warmup_excluded"
        ),
        F.coalesce(F.avg(F.when(ok, F.col("elapsed") * F.lit(1000.0))), F.lit(0.0)).alias(
            "latency_mean_ms"
        ),
        (measured < min_after).alias("insufficient_batches"),
    )
    out = out.join(percentiles, by, "left").na.fill(
        0.0, ["latency_p50_ms", "latency_p95_ms", "latency_p99_ms"]
    )
    tail = F.when(F.col("latency_p50_ms") > 0, F.col("latency_p99_ms") / F.col("latency_p50_ms"))
    return out.withColumn("latency_p99_over_p50", F.coalesce(tail, F.lit(0.0)))


def detection_delay(
    log: DataFrame,
    by: Sequence[str] = ("run",),
    warmup_min: int = WARMUP_MIN,
    warmup_fraction: float = WARMUP_FRACTION,
) -> DataFrame:
    """Buffering plus scoring delay of measured snapshots that have a span.

    Runs without any span give no row.
    """
    by = list(by)
    rows = after_warmup(log, by, warmup_min, warmup_fraction)
    rows = rows.filter(F.col("measured") & F.col("span").isNotNull() & ~F.isnan("span"))
    rows = rows.select(
        *by, "span", "elapsed", (F.col("span") + F.col("elapsed")).alias("worst")
    )
    rows = materialize(rows, "delay")
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("snapshots_with_span"),
        F.avg(F.col("span") / F.lit(2.0) + F.col("elapsed")).alias("detection_delay_mean_sec"),
        F.max("worst").alias("detection_delay_max_sec"),
        F.avg("span").alias("snapshot_span_mean_sec"),
        F.max("span").alias("snapshot_span_max_sec"),
    )
    tails = group_quantiles(
        rows, by, "worst", {"detection_delay_p95_sec": 0.95, "detection_delay_p99_sec": 0.99}
    )
    return stats.join(tails, by)


def windowed_throughput(
    log: DataFrame, by: Sequence[str] = ("run",), window_sec: float = 1.0
) -> DataFrame:
    """Edges per second in windows of the scoring clock.

    A snapshot counts in the window ``(a, b]`` in which it ends; windows in
    which none ends are kept with 0, a trailing window without edges is not.
    """
    by = list(by)
    clock = running(log, by, ["seq"], {"_clock": F.col("elapsed")})
    w = F.greatest(F.lit(0), F.ceil(F.col("_clock") / F.lit(float(window_sec))) - 1)
    filled = clock.groupBy(*by, w.cast("bigint").alias("window_id")).agg(
        F.sum("num_edges").alias("_edges")
    )
    last = filled.groupBy(*by).agg(
        F.max("window_id").alias("_last"),
        F.max_by("_edges", "window_id").alias("_tail"),
    )
    end = F.when(F.col("_tail") > 0, F.col("_last")).otherwise(F.col("_last") - 1)
    windows = last.filter(end >= 0).select(
        *by, F.explode(F.sequence(F.lit(0).cast("bigint"), end)).alias("window_id")
    )
    return windows.join(filled, [*by, "window_id"], "left").select(
        *by,
        "window_id",
        (F.coalesce("_edges", F.lit(0)) / F.lit(float(window_sec))).alias("edges_per_sec"),
    )


def latency_cdf(log: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Latency in ascending order with its cumulative fraction, per run."""
    by = list(by)
    placed = group_position(log, by, ["elapsed", "seq"], "_rn")
    sizes = log.groupBy(*by).agg(F.count("*").alias("_n"))
    return placed.join(sizes, by).select(
        *by,
        "seq",
        (F.col("elapsed") * F.lit(1000.0)).alias("latency_ms"),
        (F.col("_rn") / F.col("_n")).alias("fraction"),
    )


def run_log(log: DataFrame, pos: str, at: str) -> DataFrame:
    """Seconds since the first row and since the row before, in log order."""
    first = log.agg(F.min_by(at, pos).alias("f")).first()["f"]
    moved = shifted(log, pos, {"_prev": F.col(at)}, -1)
    return moved.withColumns(
        {
            "elapsed": F.col(at) - F.lit(first),
            "step": F.col(at) - F.coalesce("_prev", F.col(at)),
        }
    ).drop("_prev")


def convergence(history: DataFrame, metric: str, by: Sequence[str], step: str, at: str) -> DataFrame:
    """Best value of a metric, the first step that reaches it, and when."""
    best = F.max_by(F.struct(metric, step, at), F.struct(F.col(metric), -F.col(step)))
    out = history.groupBy(*by).agg(best.alias("b"), F.count("*").alias("steps"))
    return out.select(
        *by,
        "steps",
        F.col(f"b.{metric}").alias(f"best_{metric}"),
        F.col(f"b.{step}").alias("best_step"),
        F.col(f"b.{at}").alias("time_to_best"),
    )
