"""Time normalisation, splits and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tgraph.operators.ordering import (
    global_position,
    group_position,
    group_quantiles,
    running,
    shifted,
)
from tgraph.session import maybe_broadcast


def split_rank(split: str = "split") -> Column:
    return F.when(F.col(split) == "train", 0).when(F.col(split) == "val", 1).otherwise(2)


def check_time_column(df: DataFrame, col: str) -> None:
    """Raise unless ``col`` exists and is numeric or temporal."""
    if col not in df.columns:
        raise ValueError(f"time column '{col}' is missing")
    dtype = df.schema[col].dataType
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if not isinstance(dtype, (T.NumericType, *temporal)):
        raise ValueError(f"time column '{col}' is neither numeric nor temporal")


def normalize_time(df: DataFrame, col: str = "t") -> DataFrame:
    """Turn a date, timestamp, whole or decimal number column into a long.

    Dates become days, timestamps microseconds.  Doubles that are all whole
    are cast; otherwise they are scaled by ten to the largest number of
    decimals seen, so that nothing is lost.
    """
    check_time_column(df, col)
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.DateType):
        return df.withColumn(col, F.unix_date(c).cast("bigint"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        stamp = c.cast("timestamp")
        if isinstance(dtype, T.TimestampNTZType):
            stamp = F.from_utc_timestamp(stamp, F.current_timezone())
        return df.withColumn(col, F.unix_micros(stamp))
    if isinstance(dtype, T.IntegralType):
        return df.withColumn(col, c.cast("bigint"))
    exact = c.cast(T.DecimalType(38, 12))
    text = F.rtrim(exact.cast("string"), F.lit("0"))
    decimals = F.length(F.substring_index(text, ".", -1))
    seen = df.agg(F.max(decimals).alias("d")).first()["d"] or 0
    scaled = exact * F.lit(10**seen).cast(T.DecimalType(20, 0))
    return df.withColumn(col, scaled.cast("bigint"))


def sentinel_to_null(df: DataFrame, col: str, sentinel: int = -(2**31)) -> DataFrame:
    """Map the marker of a missing time to null."""
    return df.withColumn(col, F.when(F.col(col) != F.lit(sentinel), F.col(col)))


def check_ratios(train: float, val: float) -> None:
    if not 0.0 < train < 1.0:
        raise ValueError("train ratio must be in (0, 1)")
    if val < 0.0 or train + val >= 1.0:
        raise ValueError("train and val ratios must leave rows for test")


def split_by_quantile(
    edges: DataFrame, t: str, train: float, val: float = 0.0, split: str = "split"
) -> DataFrame:
    """Split at exact time quantiles; rows at a cut-off go to the earlier side."""
    check_ratios(train, val)
    if split in edges.columns:
        raise ValueError("edges are already split")
    check_time_column(edges, t)
    cuts = group_quantiles(edges, [], t, {"a": train, "b": train + val}).first()
    when = F.when(F.col(t) <= F.lit(cuts["a"]), "train")
    if val > 0:
        when = when.when(F.col(t) <= F.lit(cuts["b"]), "val")
    return edges.withColumn(split, when.otherwise("test"))


def split_by_rows(
    edges: DataFrame, pos: str, train: float, val: float = 0.0, split: str = "split"
) -> DataFrame:
    """Split at row counts along a gap-free position."""
    check_ratios(train, val)
    n = edges.agg(F.count("*").alias("n")).first()["n"]
    a, b = int(n * train), int(n * train) + int(n * val)
    when = F.when(F.col(pos) < a, "train")
    if val > 0:
        when = when.when(F.col(pos) < b, "val")
    return edges.withColumn(split, when.otherwise("test"))


def event_order(
    edges: DataFrame, t: str = "t", src: str = "src", tie: tuple[str, ...] = ("tgt",)
) -> DataFrame:
    """Position in event order: by time, then source, then the tie columns."""
    return global_position(edges, [t, src, *tie])


def position_in_split(
    edges: DataFrame, pos: str = "edge_pos", name: str = "split_pos"
) -> DataFrame:
    """0-based position inside each split.

    Splits cut along time are contiguous runs of ``pos``; then three starts
    are enough.  Interleaved splits fall back to a position per group.
    """
    spans = edges.groupBy("split").agg(
        F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count("*").alias("n")
    )
    rows = spans.collect()  # one row per split
    if all(r["hi"] - r["lo"] + 1 == r["n"] for r in rows):
        start = F.lit(None).cast("bigint")
        for r in rows:
            start = F.when(F.col("split") == r["split"], r["lo"]).otherwise(start)
        return edges.withColumn(name, F.col(pos) - start)
    placed = group_position(edges, ["split"], [pos], name)
    return placed.withColumn(name, F.col(name) - 1)


def count_snapshots(
    edges: DataFrame, size: int, pos: str = "edge_pos", name: str = "snapshot_id"
) -> DataFrame:
    """Snapshots of ``size`` consecutive edges, numbered anew in each split."""
    _check_size(size)
    placed = position_in_split(edges, pos, "_p")
    return placed.withColumn(name, _div(F.col("_p"), size)).drop("_p")


def whole_table_snapshots(
    edges: DataFrame, size: int, pos: str = "edge_pos", name: str = "snapshot_id"
) -> DataFrame:
    """Snapshots of ``size`` consecutive edges, splits ignored."""
    _check_size(size)
    return edges.withColumn(name, _div(F.col(pos), size))


def continued_snapshots(
    edges: DataFrame, size: int, pos: str = "edge_pos", name: str = "snapshot_id"
) -> DataFrame:
    """Count snapshots whose numbers run on over train, val and test."""
    local = count_snapshots(edges, size, pos, "_local")
    last = {
        r["split"]: r["n"]
        for r in local.groupBy("split").agg((F.max("_local") + 1).alias("n")).collect()
    }
    offset, shift = 0, F.lit(0).cast("bigint")
    for split in ("train", "val", "test"):
        shift = F.when(F.col("split") == split, F.lit(offset)).otherwise(shift)
        offset += last.get(split, 0)
    return local.withColumn(name, F.col("_local") + shift).drop("_local")


def time_snapshots(
    edges: DataFrame, size: int, t: str = "t", name: str = "snapshot_id"
) -> DataFrame:
    """Snapshots of ``size`` time units from the earliest edge.

    A split that begins in the snapshot where the one before ended is moved on
    by one, so that no snapshot holds edges of two splits.
    """
    _check_size(size)
    first = edges.agg(F.min(t).alias("m")).first()["m"]
    raw = edges.withColumn("_raw", _div(F.col(t) - F.lit(first), size))
    if "split" not in edges.columns:
        return raw.withColumnRenamed("_raw", name)
    ends = {
        r["split"]: (r["lo"], r["hi"])
        for r in raw.groupBy("split")
        .agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi"))
        .collect()
    }
    previous, shift = None, F.lit(0).cast("bigint")
    for split in ("train", "val", "test"):
        if split not in ends:
            continue
        lo, hi = ends[split]
        move = 1 if previous is not None and lo == previous else 0
        shift = F.when(F.col("split") == split, F.lit(move)).otherwise(shift)
        previous = hi + move
    return raw.withColumn(name, F.col("_raw") + shift).drop("_raw")


def event_snapshots(
    edges: DataFrame, pos: str = "edge_pos", src: str = "src", name: str = "snapshot_id"
) -> DataFrame:
    """One snapshot per maximal run of equal sources inside a split."""
    placed = position_in_split(edges, pos, "_sp")
    moved = shifted(placed, pos, {"_prev": F.struct("split", src)}, -1)
    starts = (F.col("_sp") == 0) | ~F.struct("split", src).eqNullSafe(F.col("_prev"))
    flagged = moved.withColumn("_new", starts.cast("bigint")).drop("_prev", "_sp")
    counted = running(flagged, ["split"], [pos], {"_run": F.col("_new")})
    return counted.withColumn(name, F.col("_run") - 1).drop("_new", "_run")


def instant_snapshots(
    edges: DataFrame, t: str = "t", name: str = "snapshot_id"
) -> DataFrame:
    """One snapshot per distinct time, numbered in time order."""
    numbered = global_position(edges.select(t).distinct(), [t], name)
    return edges.join(maybe_broadcast(numbered), t)


def snapshot_summary(edges: DataFrame, t: str = "t") -> DataFrame:
    """Per split and snapshot: edges, distinct nodes, mean degree, time span."""
    sizes = edges.groupBy("split", "snapshot_id").agg(
        F.count("*").alias("num_edges"),
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        (F.max(t) - F.min(t)).alias("span"),
    )
    ends = edges.select("split", "snapshot_id", F.explode(F.array("src", "tgt")).alias("v"))
    nodes = (
        ends.distinct().groupBy("split", "snapshot_id").agg(F.count("*").alias("num_nodes"))
    )
    return sizes.join(nodes, ["split", "snapshot_id"]).withColumn(
        "mean_degree", F.lit(2.0) * F.col("num_edges") / F.col("num_nodes")
    )


def cumulative_summary(edges: DataFrame, pos: str = "edge_pos") -> DataFrame:
    """Per snapshot the size of everything up to its last edge, all splits.

    Positions have no gaps, so the cumulative edge count is the last position
    plus one; nodes count from the snapshot in which they are first seen.
    """
    ends = edges.groupBy("split", "snapshot_id").agg(
        F.count("*").alias("current_edges"), F.max(pos).alias("last_pos")
    )
    first_seen = (
        edges.select(F.explode(F.array("src", "tgt")).alias("v"), pos)
        .groupBy("v")
        .agg(F.min(pos).alias("at"))
    )
    marks = first_seen.select(F.col("at").alias("_p"), F.lit(1).alias("_w")).unionByName(
        ends.select(F.col("last_pos").alias("_p"), F.lit(0).alias("_w"))
    )
    marks = marks.groupBy("_p").agg(F.sum("_w").alias("_w"))
    seen = running(marks, [], ["_p"], {"cumulative_nodes": F.col("_w")})
    return ends.join(
        seen.select(F.col("_p").alias("last_pos"), "cumulative_nodes"), "last_pos"
    ).select(
        "split",
        "snapshot_id",
        "current_edges",
        (F.col("last_pos") + 1).alias("cumulative_edges"),
        "cumulative_nodes",
    )


def snapshot_edges(
    edges: DataFrame, snapshot_id: int, accumulate: bool = False, split: str | None = None
) -> DataFrame:
    """Edges of one snapshot, or of all snapshots up to it."""
    keep = (
        F.col("snapshot_id") <= snapshot_id
        if accumulate
        else F.col("snapshot_id") == snapshot_id
    )
    if split is not None:
        keep = keep & (F.col("split") == split)
    return edges.filter(keep)


def present_nodes(nodes: DataFrame, edges: DataFrame, node_id: str = "node_id") -> DataFrame:
    """Nodes that occur in ``edges``."""
    seen = edges.select(F.explode(F.array("src", "tgt")).alias(node_id)).distinct()
    return nodes.join(seen, node_id, "left_semi")


def iterate_nodes(edges: DataFrame) -> DataFrame:
    """(snapshot_id, node_id, is_new): the nodes of every snapshot.

    All rows of a snapshot are its nodes; the nodes seen up to it are the rows
    with ``is_new`` of no later snapshot. So the accumulated views of all snapshots
    together are no larger than the exact ones.
    """
    n = edges.select("snapshot_id", F.explode(F.array("src", "tgt")).alias("node_id")).distinct()
    first = n.groupBy("node_id").agg(F.min("snapshot_id").alias("_first"))
    return n.join(first, "node_id").select("snapshot_id", "node_id", (F.col("snapshot_id") == F.col("_first")).alias("is_new"))


def shared_nodes(edges: DataFrame) -> DataFrame:
    """Nodes each snapshot has in common with the one before."""
    n = edges.select("snapshot_id", F.explode(F.array("src", "tgt")).alias("node_id")).distinct()
    before = n.select((F.col("snapshot_id") + 1).alias("snapshot_id"), "node_id")
    return n.join(before, ["snapshot_id", "node_id"])


def lookback(edges: DataFrame, width: int, name: str = "lookback_id") -> DataFrame:
    """Each edge once per snapshot n-width+1 .. n; ids below 0 do not exist."""
    _check_size(width)
    first = F.greatest(F.lit(0), F.col("snapshot_id") - F.lit(width - 1))
    return edges.withColumn(name, F.explode(F.sequence(first, F.col("snapshot_id"))))


def _check_size(size: int) -> None:
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError("size must be a positive integer")


def _div(c: Column, size: int) -> Column:
    """Floor division of longs, in whole numbers throughout."""
    d = F.lit(size).cast("bigint")
    return F.call_function("div", c - F.pmod(c, d), d)
