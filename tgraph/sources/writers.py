"""Writers: datasets, injected variants, caches and result files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tgraph.plans.graph import TemporalGraph


def variant_name(kind: str | None, ratios: Mapping[str, float], duration: float | str) -> str:
    """Folder name of an injected variant; ``clean`` without injection."""
    if not kind:
        return "clean"
    tr, va, te = (ratios.get(s, 0.0) for s in ("train", "val", "test"))
    return f"{kind}_tr{tr}_v{va}_te{te}_dur{duration}"


def parameter_hash(parameters: Any) -> str:
    """md5 of a parameter dict or list, independent of key order."""
    return hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def write_dataset(tables: Mapping[str, DataFrame], directory: str, name: str) -> None:
    """Write edges and side tables as one folder of parquet tables."""
    if "edges" not in tables:
        raise ValueError("a dataset needs edges")
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}/{table}.parquet")


def variant_metadata(edges: DataFrame) -> DataFrame:
    """One row of counts that describes an edge table."""
    aggs = [F.count("*").alias("num_edges"), (F.max(F.greatest("src", "tgt")) + 1).alias("num_nodes")]
    if "group_id" in edges.columns:
        aggs += [
            F.max("group_id").alias("anomaly_groups"),
            F.count_if(F.col("group_id") > 0).alias("anomalous_edges"),
        ]
    return edges.agg(*aggs)


def save_variant(
    graph: TemporalGraph, root: str, dataset: str, variant: str, spark: SparkSession | None = None
) -> str:
    """Write a variant under dataset= / variant= with a one-row summary."""
    path = f"{root}/dataset={dataset}/variant={variant}"
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    if graph.nodes is not None:
        graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    facts = json.dumps(dict(graph.metadata), default=str)
    summary = variant_metadata(graph.edges).withColumn("metadata", F.lit(facts))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_variant(
    spark: SparkSession,
    root: str,
    dataset: str,
    variant: str,
    build: Callable[[], TemporalGraph] | None = None,
) -> TemporalGraph:
    """Read a variant, or build and save it if it is not there."""
    from tgraph.sources.readers import _exists

    path = f"{root}/dataset={dataset}/variant={variant}"
    if not _exists(spark, f"{path}/edges/_SUCCESS"):
        if build is None:
            raise FileNotFoundError(path)
        save_variant(build(), root, dataset, variant)
    nodes = spark.read.parquet(f"{path}/nodes") if _exists(spark, f"{path}/nodes") else None
    facts = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    return TemporalGraph(spark.read.parquet(f"{path}/edges"), nodes, metadata=facts)


class StepCache:
    """Keeps each step's edges under a key of all parameters up to it."""

    def __init__(self, root: str, force: bool = False) -> None:
        self.root, self.force = root.rstrip("/"), force

    def path(self, index: int, parameters: Any) -> str:
        return f"{self.root}/{index:02d}-{parameter_hash(parameters)}"

    def run(self, index: int, parameters: Any, spark: SparkSession, make: Callable[[], TemporalGraph]) -> TemporalGraph:
        from tgraph.sources.readers import _exists

        path = self.path(index, parameters)
        if self.force or not _exists(spark, f"{path}/edges/_SUCCESS"):
            graph = make()
            graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
            if graph.nodes is not None:
                graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
            facts = spark.createDataFrame([(json.dumps(dict(graph.metadata), default=str),)], "metadata string")
            facts.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
        nodes = spark.read.parquet(f"{path}/nodes") if _exists(spark, f"{path}/nodes") else None
        facts = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
        return TemporalGraph(spark.read.parquet(f"{path}/edges"), nodes, metadata=facts)


def save_analysis(stats: DataFrame, communities: DataFrame, path: str) -> None:
    """The graph statistics row and the community table."""
    stats.write.mode("overwrite").parquet(f"{path}/graph_stats")
    communities.write.mode("overwrite").parquet(f"{path}/communities")


def load_analysis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/graph_stats"), spark.read.parquet(f"{path}/communities")


def write_evaluation(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-run metrics and their summary; both have a handful of rows."""
    results.coalesce(1).write.mode("overwrite").json(f"{path}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_run_metrics(metrics: DataFrame, path: str, by: tuple[str, ...] = ("method", "dataset")) -> None:
    metrics.write.mode("overwrite").partitionBy(*by).json(path)


def write_benchmark(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    results.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def write_sidecars(rows: DataFrame, path: str, by: str = "run") -> None:
    """One JSON object per run with its arrays in the order of ``seq``.

    ``rows`` has (run, seq, latency_ms, num_edges, mean_degree, span); a run's
    arrays are one value by the format.
    """
    item = F.struct("seq", "latency_ms", "num_edges", "mean_degree", "span")
    packed = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("l"))
    names = {"per_snapshot_latency_ms": "latency_ms", "per_snapshot_edges": "num_edges", "per_snapshot_mean_degree": "mean_degree", "per_snapshot_span_sec": "span"}
    out = packed.select(F.col(by).alias("slug"), *[F.col(f"l.{c}").alias(n) for n, c in names.items()])
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pack_graph(graph: TemporalGraph, prefix: str = "feat") -> TemporalGraph:
    """Core columns with all feature columns packed into one array ``msg``.

    Labels default to 0 and weights to 1.  Node ids must be 0..N-1 when there
    is a node table with features.
    """
    e = graph.edges
    features = graph.feature_columns(prefix)
    msg = F.array(*[F.col(c).cast("double") for c in features]) if features else F.array().cast("array<double>")
    label = F.col("label").cast("int") if "label" in e.columns else F.lit(0)
    split = F.col("split") if "split" in e.columns else F.lit("train")
    out = e.select(
        F.col(graph.edge_id).alias("edge_id"), F.col(graph.src).alias("src"), F.col(graph.tgt).alias("tgt"),
        F.col(graph.t).alias("t"), msg.alias("msg"), label.alias("label"), split.alias("split"),
        F.lit(1.0).alias("w"),
    )
    if graph.nodes is not None and any(c.startswith(prefix) for c in graph.nodes.columns):
        row = graph.nodes.agg(
            F.min(graph.node_id).alias("a"), F.max(graph.node_id).alias("b"), F.countDistinct(graph.node_id).alias("n")
        ).first()
        if row["a"] != 0 or row["b"] != row["n"] - 1:
            raise ValueError("node ids must be 0..N-1 when nodes have features")
    return TemporalGraph(out, graph.nodes, metadata=graph.metadata)


def legacy_columns(graph: TemporalGraph) -> tuple[DataFrame, DataFrame]:
    """The older column names; identity features as a sparse (node, index)."""
    names = {"edge_id": "e_id", "src": "e_src", "tgt": "e_tgt", "t": "e_timestamp", "label": "e_label", "split": "e_split"}
    edges = graph.edges.withColumnsRenamed({k: v for k, v in names.items() if k in graph.edges.columns})
    if graph.nodes is not None:
        return edges, graph.nodes.withColumnRenamed(graph.node_id, "n_id")
    ids = graph.edges.select(F.explode(F.array("src", "tgt")).alias("n_id")).distinct()
    return edges, ids.withColumn("hot", F.col("n_id"))
