"""Exact runs of equal sources over a stream that is not in time order.

Edges wait, counted by time and source, until the newest edge of the batches so far is
``late`` ticks ahead of them; then nothing that is still accepted can come before
them, and they are put in order. Older edges than that are listed, not used.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tgraph.operators.ordering import global_position, running, shifted
from tgraph.session import materialize


def event_runs(edges: DataFrame, root: str, late: int) -> StreamingQuery:
    """Start the runs of a stream (src, t, more columns), written under ``root``, a shared folder.

    A run is a longest stretch of edges with one source (null is one) in the order (t, src). Edges
    without a time are late. ``read_runs`` and ``read_late`` give what is written, ``finish``
    ends the last runs when the input is over.

    A batch writes its own folders, and reads those of the batch before it, so that it can
    be repeated after a failure. What waits lies in two folders in turn.
    """
    return (
        edges.writeStream.option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, k: _step(root, batch, k, late))
        .start()
    )


def finish(spark: SparkSession, root: str, schema: T.StructType) -> None:
    """Put in order what still waits when the input is over; without any batch there are no runs."""
    try:
        done = spark.read.parquet(f"{root}/marks").agg(F.max("batch_id").alias("k")).first()["k"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = -1
    _step(root, spark.createDataFrame([], schema), done + 1, None)


def read_runs(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Runs (run, src, edges, t_min, t_max) in order from 0; one that goes on over batches is one row."""
    pieces = spark.read.schema(_pieces(schema)).parquet(f"{root}/runs")
    return pieces.groupBy("run", "src").agg(
        F.sum("edges").alias("edges"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max")
    )


def read_late(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The edges that came too late, with all their columns and the batch."""
    every = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(every).parquet(f"{root}/late")


def _pieces(schema: T.StructType) -> T.StructType:
    out = T.StructType().add("run", T.LongType()).add("src", schema["src"].dataType).add("edges", T.LongType())
    return out.add("t_min", schema["t"].dataType).add("t_max", schema["t"].dataType)


def _step(root: str, batch: DataFrame, k: int, late: int | None) -> None:
    """One batch; ``late`` None closes everything."""
    spark = batch.sparkSession
    held = T.StructType([batch.schema["t"], batch.schema["src"]]).add("edges", T.LongType())
    marks = T.StructType().add("bound", T.LongType()).add("run", T.LongType()).add("src", batch.schema["src"].dataType)
    bound, run, src = None, -1, None
    waiting = spark.createDataFrame([], held)
    if k > 0:
        bound, run, src = spark.read.schema(marks).parquet(f"{root}/marks/batch_id={k - 1}").first()
        waiting = spark.read.schema(held).parquet(f"{root}/waiting/{(k - 1) % 2}")

    in_time = F.col("t").isNotNull()
    if bound is not None:
        in_time = in_time & (F.col("t") >= F.lit(bound))
    batch.filter(~F.coalesce(in_time, F.lit(False))).write.mode("overwrite").parquet(f"{root}/late/batch_id={k}")
    new = batch.filter(in_time).groupBy("t", "src").agg(F.count("*").alias("edges"))
    rows = materialize(
        waiting.unionByName(new).groupBy("t", "src").agg(F.sum("edges").alias("edges")), "held"
    )
    if late is None:
        closed = rows
        bound = None
        rest = rows.filter(F.lit(False))
    else:
        newest = rows.agg(F.max("t").alias("t")).first()["t"]
        if newest is not None:
            bound = max(newest - late, newest - late if bound is None else bound)
        closed = rows.filter(F.col("t") < F.lit(bound).cast("bigint"))
        rest = rows.filter(F.col("t") >= F.lit(bound).cast("bigint"))
    rest.write.mode("overwrite").parquet(f"{root}/waiting/{k % 2}")

    placed = shifted(global_position(closed, ["t", "src"], "_p"), "_p", {"_prev": F.struct("src")}, -1)
    first = F.lit(run < 0) | ~F.col("src").eqNullSafe(F.lit(src).cast(batch.schema["src"].dataType))
    starts = F.when(F.col("_prev").isNull(), first).otherwise(~F.col("src").eqNullSafe(F.col("_prev.src")))
    counted = running(placed.withColumn("_new", starts.cast("bigint")), [], ["_p"], {"_run": F.col("_new")})
    pieces = counted.groupBy((F.col("_run") + F.lit(run)).alias("run"), "src").agg(
        F.sum("edges").alias("edges"), F.min("t").alias("t_min"), F.max("t").alias("t_max")
    )
    pieces.write.mode("overwrite").parquet(f"{root}/runs/batch_id={k}")
    written = spark.read.schema(_pieces(batch.schema)).parquet(f"{root}/runs/batch_id={k}")
    last = written.agg(F.max_by(F.struct("run", "src"), "run").alias("l")).first()["l"]
    if last is not None:
        run, src = last
    spark.createDataFrame([(bound, run, src)], marks).write.mode("overwrite").parquet(f"{root}/marks/batch_id={k}")
