"""Result tables: summaries, leaderboards, pivots and sweeps."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tgraph.operators.ordering import group_quantiles

RESULT_DIMENSIONS = ("method", "dataset", "anom_type", "anom_ratio", "anom_duration")

RESULT_SCHEMA = (
    "method string, dataset string, anom_type string, anom_ratio double, "
    "anom_duration double, auprc double, rocauc double"
)

# Cells known not to finish.
KNOWN_FAILURES = {
    ("taddy", "as-topology"): "memory-bound",
    ("taddy", "enron"): "memory-bound",
    ("taddy", "epinions"): "memory-bound",
    ("generaldyg", "as-topology"): "memory-bound",
    ("generaldyg", "epinions"): "memory-bound",
    ("strgnn", "epinions"): "compute-bound",
    ("sad", "epinions"): "compute-bound",
    ("addgraph", "epinions"): "compute-bound",
}


def run_summary(runs: DataFrame, metrics: Sequence[str], digits: int | None = 2) -> DataFrame:
    """Mean, sample deviation, min and max of each metric over runs, long form."""
    long = runs.unpivot([], list(metrics), "metric", "value")

    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    return long.groupBy("metric").agg(
        shown(F.avg("value")).alias("mean"),
        shown(F.stddev_samp("value")).alias("std"),
        shown(F.min("value")).alias("min"),
        shown(F.max("value")).alias("max"),
    )


def result_filter(results: DataFrame, **allowed: Sequence[Any]) -> DataFrame:
    """Keep rows whose dimensions are in the given lists."""
    for name, values in allowed.items():
        if name not in results.columns:
            raise ValueError(f"unknown dimension '{name}'")
        results = results.filter(F.col(name).isin(list(values)))
    return results


def summarize(
    results: DataFrame, metric: str, dimensions: Sequence[str], together: bool = False
) -> DataFrame:
    """Mean, median, max, min, deviation and count of a metric.

    One dimension at a time in one pass over the rows: each row is expanded to
    (dimension, value) and grouped once, or, with ``together``, grouped by all
    of them.  The median is exact and found by rank.
    """
    if together:
        keys, rows = list(dimensions), results.select(*dimensions, metric)
    else:
        keys = ["dimension", "value"]
        items = [
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
        rows = results.select(metric, F.explode(F.array(*items)).alias("_i")).select(
            "_i.dimension", "_i.value", metric
        )
    stats = rows.groupBy(*keys).agg(
        F.avg(metric).alias("mean"),
        F.max(metric).alias("max"),
        F.min(metric).alias("min"),
        F.stddev_samp(metric).alias("std"),
        F.count(metric).alias("n"),
    )
    return stats.join(group_quantiles(rows, keys, metric, {"median": 0.5}), keys, "left")


def leaderboard(
    results: DataFrame, where: Mapping[str, Any], metric: str, columns: Sequence[str], top: int | None = None
) -> DataFrame:
    """Rows of one configuration, best first."""
    for k, v in where.items():
        results = results.filter(F.col(k) == F.lit(v))
    board = results.select(*columns, metric).orderBy(F.col(metric).desc_nulls_last(), *columns)
    return board if top is None else board.limit(top)


def heat_map(
    results: DataFrame, row: str, axes: Sequence[str], cells: Sequence[Sequence[Any]], metric: str
) -> DataFrame:
    """One row per ``row`` value, one fixed column per axis combination."""
    key = F.concat_ws("_", *[F.col(a).cast("string") for a in axes])
    names = ["_".join(str(v) for v in c) for c in cells]
    return results.withColumn("_cell", key).groupBy(row).pivot("_cell", names).agg(F.first(metric, True))


def median_pivot(
    df: DataFrame, index: str, on: str, values: Sequence[str], metric: str
) -> DataFrame:
    """Exact median of a metric per index row and column value."""
    medians = group_quantiles(df, [index, on], metric, {"_m": 0.5})
    return medians.groupBy(index).pivot(on, list(values)).agg(F.first("_m"))


def throughput_table(
    bench: DataFrame,
    datasets: Sequence[str],
    failures: Mapping[tuple[str, str], str] = KNOWN_FAILURES,
    metric: str = "throughput_warmup_excluded",
) -> DataFrame:
    """Median throughput per method and dataset as text.

    A known failure is named instead; a missing value is shown as ``--``.
    """
    table = median_pivot(bench, "method", "dataset", datasets, metric)
    cells = []
    for d in datasets:
        cell = F.coalesce(F.format_number(F.col(f"`{d}`"), 0), F.lit("--"))
        for (method, dataset), why in failures.items():
            if dataset == d:
                cell = F.when(F.col("method") == method, F.lit(f"OOM ({why})")).otherwise(cell)
        cells.append(cell.alias(d))
    return table.select("method", *cells)


def outcome_table(bench: DataFrame, by: Sequence[str] = ("method", "dataset")) -> DataFrame:
    """Runs, successes and the first error of each cell."""
    return bench.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.min("error").alias("error"),
    )


def experiment_grid(
    spark: SparkSession,
    datasets: Sequence[str],
    types: Sequence[str],
    rates: Sequence[float],
    durations: Sequence[float],
    window_sizes: Mapping[str, int],
    default_window: int,
) -> DataFrame:
    """Every configuration of an experiment as one small table."""
    rows = [
        (d, k, float(r), float(s), int(window_sizes.get(d, default_window)))
        for d, k, r, s in itertools.product(datasets, types, rates, durations)
    ]
    schema = "dataset string, anom_type string, anom_ratio double, anom_duration double, window_size int"
    return spark.createDataFrame(rows, schema)


def merge_config(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Merge nested settings; later layers win, nested dicts merge by key."""
    merged: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, Mapping) and isinstance(merged.get(key), Mapping):
                merged[key] = merge_config(merged[key], value)
            else:
                merged[key] = value
    return merged


def search_space(space: Mapping[str, Sequence[Any]], samples: int | None = None, seed: int = 0) -> list[dict]:
    """All combinations, or a seeded choice of ``samples`` of them."""
    combos = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    if samples is None or samples >= len(combos):
        return combos
    return random.Random(seed).sample(combos, samples)
