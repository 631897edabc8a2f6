"""Replaying an edge table as a stream, and collecting what a query emits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tgraph.session import scratch_dir


def write_slices(edges: DataFrame, slices: int, pos: str = "edge_pos", unit: float = 1e6) -> str:
    """Write edges as consecutive files in position order; returns the folder.

    ``ts`` is the event time from ``t`` in ticks of ``1/unit`` seconds.
    """
    path = f"{scratch_dir(edges.sparkSession)}/tgraph/replay-{uuid.uuid4().hex}"
    n = edges.agg(F.max(pos).alias("m")).first()["m"] + 1
    step = -(-n // slices)
    stamped = edges.withColumn("ts", F.timestamp_micros((F.col("t") / F.lit(unit) * 1_000_000).cast("bigint")))
    for i in range(slices):
        part = stamped.filter((F.col(pos) >= i * step) & (F.col(pos) < (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Edge files as a stream, ``files`` per micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_to_table(stream: DataFrame, mode: str, label: str = "out") -> tuple[DataFrame, StreamingQuery]:
    """Run all available input and return everything emitted, with ``batch_id``.

    Each batch overwrites its own folder, so a batch that is tried again after
    a failure does not repeat rows.
    """
    spark = stream.sparkSession
    root = f"{scratch_dir(spark)}/tgraph/{label}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{root}/rows"), query


def latest(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """The last emitted row of each key of an update-mode query."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch_id")]
    out = emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return out.select(*keys, *[f"r.{c}" for c in rest])


def score_batches(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Score each micro-batch with a batch operator and append the result."""

    def one(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(one)
        .start()
    )
    query.awaitTermination()
    return query


def progress_log(query: StreamingQuery, run: str) -> DataFrame:
    """Batch progress as a timing log (run, seq, num_edges, elapsed)."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()
    rows = [
        (run, int(p["batchId"]), int(p["numInputRows"]), p["durationMs"].get("triggerExecution", 0) / 1000.0)
        for p in query.recentProgress
        if p["numInputRows"] > 0
    ]
    return spark.createDataFrame(rows, "run string, seq bigint, num_edges bigint, elapsed double")
