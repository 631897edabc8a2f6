"""Positions, running sums and shifted rows without a one-task window.

A DataFrame has no row order, and a window over one hot group is one task.
Everything here sorts by range partitions instead: the sort key includes the
full order, so a group holding a third of all rows is spread over many tasks,
and only one summary row per partition (or per partition and group) travels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tgraph.session import GROUP_ROWS, at_most, materialize

# Rows per window group once a global position exists.
CHUNK_ROWS = 1 << 16

# A whole table up to this many rows may be folded by one sorted task.
SMALL_ROWS = 100_000

_ROW_BITS = 33

_FOLDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def global_position(
    df: DataFrame, order: Sequence[str | Column], name: str = "edge_pos"
) -> DataFrame:
    """Add the 0-based position of each row in ``order`` (a total order).

    One range shuffle. The row number inside a range partition comes from the
    id Spark gives rows in partition order, and the offsets are one count per
    partition. The stamped table is written first, so both passes agree.
    """
    spark = df.sparkSession
    # adaptive execution may merge neighbouring ranges, which keeps the order
    stamped = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftrightunsigned(F.col("_row"), _ROW_BITS)
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = stamped.groupBy(part.alias("_part")).count().collect()
    start, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], start))
        start += row["count"]
    if len(offsets) <= 1:
        return stamped.withColumn(name, local).drop("_row")
    # one row per range partition
    starts = spark.createDataFrame(offsets, "_part bigint, _start bigint")
    return (
        stamped.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + local)
        .drop("_row", "_part", "_start")
    )


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Row count of the largest group, by a map-side combined count."""
    row = df.groupBy(*group).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    group_rows: int = GROUP_ROWS,
    how: str = "sum",
    bounded: bool = False,
) -> DataFrame:
    """Inclusive running sums (or max, min) inside each group, in ``order``.

    ``order`` must be total.  Groups (or a whole table) whose counted size one
    task can sort use a plain window.  Otherwise the rows are
    range-partitioned by (group, order), folded per partition, and combined
    with the totals of earlier partitions.  ``bounded`` says that the groups
    cannot be large by construction, which saves counting them.
    """
    group = list(group)
    names = list(sums)
    fold, join_up = _FOLDS[how]
    if group:
        small = bounded or largest_group(df, group) <= group_rows
    else:
        small = at_most(df, min(SMALL_ROWS, group_rows))
    if small:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[fold(c).over(w).alias(n) for n, c in sums.items()])

    parts = materialize(
        df.select("*", *[c.alias(f"_v_{k}") for k, c in sums.items()])
        .repartitionByRange(*group, *order)
        .withColumn("_part", F.spark_partition_id()),
        "running",
    )
    keys = ["_part", *group]
    w = Window.partitionBy(*keys).orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select(
        "*", *[fold(f"_v_{k}").over(w).alias(f"_l_{k}") for k in names]
    )
    totals = parts.groupBy(*keys).agg(*[fold(f"_v_{k}").alias(f"_s_{k}") for k in names])
    # at most one row per partition in each group
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    across = across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        *[fold(f"_s_{k}").over(across).alias(f"_b_{k}") for k in names],
    )
    out = local.join(before, keys)
    return out.select(
        *df.columns,
        *[
            F.when(F.col(f"_b_{k}").isNull(), F.col(f"_l_{k}"))
            .otherwise(join_up(F.col(f"_l_{k}"), F.col(f"_b_{k}")))
            .alias(k)
            for k in names
        ],
    )


def group_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str = "rn",
    group_rows: int = GROUP_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Add the 1-based position inside each group, hot groups included."""
    ones = {name: F.lit(1).cast("bigint")}
    return running(df, group, order, ones, group_rows, bounded=bounded)


def shifted(
    df: DataFrame,
    pos: str,
    take: Mapping[str, Column],
    by: int,
    group: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add values of the next (``by=1``) or previous (``by=-1``) row.

    ``pos`` is a gap-free position that sorts by ``group`` first. Rows are cut
    into equal chunks of positions; the row at a chunk border is copied into
    the neighbouring chunk, so no chunk has to look elsewhere.
    """
    if by not in (1, -1):
        raise ValueError("by must be 1 or -1")
    home = F.floor(F.col(pos) / F.lit(chunk_rows)).cast("bigint")
    edge = 0 if by == 1 else chunk_rows - 1
    at_border = F.col(pos) % F.lit(chunk_rows) == F.lit(edge)
    spread = df.withColumn("_home", home).withColumn(
        "_chunk",
        F.explode(
            F.when(at_border, F.array("_home", F.col("_home") - F.lit(by))).otherwise(
                F.array("_home")
            )
        ),
    )
    w = Window.partitionBy("_chunk").orderBy(pos)

    def moved(c: Column) -> Column:
        return F.lead(c, 1).over(w) if by == 1 else F.lag(c, 1).over(w)

    same = F.lit(True)
    for g in group:
        same = same & moved(F.col(g)).eqNullSafe(F.col(g))
    out = spread.select(
        "*", *[F.when(same, moved(c)).alias(k) for k, c in take.items()]
    )
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def group_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per group.

    Equal values are counted first, then the cumulative count locates the two
    order statistics of each quantile; no group's values are gathered.
    """
    group = list(group)
    counted = materialize(
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c")),
        "counted",
    )
    cumulative = running(counted, group, ["_v"], {"_hi": F.col("_c")}, group_rows)
    sizes = counted.groupBy(*group).agg(F.sum("_c").alias("_n"))
    if group:
        located = cumulative.join(sizes, group)
    else:
        located = cumulative.withColumn("_n", F.lit(sizes.first()["_n"] or 0))
    aggs = []
    for name, p in quantiles.items():
        k = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(k).cast("bigint"), F.ceil(k).cast("bigint")
        first = F.col("_hi") - F.col("_c")

        def at(i: Column, first: Column = first) -> Column:
            inside = (first <= i) & (i < F.col("_hi"))
            return F.max(F.when(inside, F.col("_v").cast("double")))

        frac = F.max(k - lo.cast("double"))
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return located.groupBy(*group).agg(*aggs)
