"""The graph container passed between steps."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class TemporalGraph:
    """Edges and optional nodes as lazy DataFrames, plus column names.

    ``metadata`` is a small driver-side dict describing how the frames were
    made; it never holds rows.
    """

    edges: DataFrame
    nodes: DataFrame | None = None
    src: str = "src"
    tgt: str = "tgt"
    t: str = "t"
    edge_id: str = "edge_id"
    node_id: str = "node_id"
    node_t: str = "timestamp"
    metadata: Mapping[str, Any] = field(default_factory=dict)

    def with_edges(self, edges: DataFrame) -> TemporalGraph:
        return replace(self, edges=edges)

    def with_nodes(self, nodes: DataFrame | None) -> TemporalGraph:
        return replace(self, nodes=nodes)

    def noting(self, **facts: Any) -> TemporalGraph:
        return replace(self, metadata={**self.metadata, **facts})

    def split_edges(self, split: str) -> DataFrame:
        return self.edges.filter(F.col("split") == split)

    def split_nodes(self, split: str) -> DataFrame | None:
        """Nodes of one split; static nodes belong to every split."""
        if self.nodes is None or "split" not in self.nodes.columns:
            return self.nodes
        return self.nodes.filter(F.col("split") == split)

    def feature_columns(self, prefix: str = "feat") -> list[str]:
        return [c for c in self.edges.columns if c.startswith(prefix)]

    def num_nodes(self) -> int:
        """Largest node id + 1, also when ids have gaps."""
        row = self.edges.agg(F.max(F.greatest(self.src, self.tgt)).alias("m")).first()
        return 0 if row["m"] is None else int(row["m"]) + 1

    def describe(self) -> DataFrame:
        """Edge and node counts, overall and per split, as one row."""
        counts = [
            F.count("*").alias("num_edges"),
            (F.max(F.greatest(self.src, self.tgt)) + 1).alias("num_nodes"),
            F.min(self.t).alias("t_min"),
            F.max(self.t).alias("t_max"),
        ]
        if "split" in self.edges.columns:
            counts += [
                F.count_if(F.col("split") == s).alias(f"{s}_edges") for s in SPLITS
            ]
        if "label" in self.edges.columns:
            counts.append(F.count_if(F.col("label") != 0).alias("anomalous_edges"))
        return self.edges.agg(*counts)
