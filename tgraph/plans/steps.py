"""Cleaning steps chained over a graph.

A step takes and returns a ``TemporalGraph`` of lazy frames; checks run on the
schema before any job starts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tgraph.operators import features, structure, timeline
from tgraph.plans.graph import TemporalGraph
from tgraph.sources.readers import load_dataset
from tgraph.sources.writers import StepCache


class Step:
    """validate, then process; ``parameters`` identify the step in a cache."""

    def validate(self, graph: TemporalGraph | None) -> None:
        if graph is None:
            raise ValueError(f"{type(self).__name__} needs a graph")

    def process(self, graph: TemporalGraph) -> TemporalGraph:
        raise NotImplementedError

    def parameters(self) -> dict[str, Any]:
        return {"step": type(self).__name__, **{k: repr(v) for k, v in vars(self).items() if k != "spark"}}

    def __call__(self, graph: TemporalGraph | None) -> TemporalGraph:
        self.validate(graph)
        return self.process(graph)


@dataclass
class Load(Step):
    """Read a structured dataset folder."""

    spark: SparkSession
    directory: str
    name: str

    def validate(self, graph: TemporalGraph | None) -> None:
        return None

    def process(self, graph: TemporalGraph | None) -> TemporalGraph:
        return load_dataset(self.spark, self.directory, self.name)


@dataclass
class CleanStructure(Step):
    """Direction, self-loops, duplicates and dense node ids."""

    directionality: str = "canonical"
    reindex_nodes: bool = True
    remove_self_loops: bool = True
    remove_duplicates: bool = True

    def validate(self, graph: TemporalGraph | None) -> None:
        super().validate(graph)
        if self.directionality not in ("directed", "canonical", "undirected"):
            raise ValueError(f"unknown directionality '{self.directionality}'")

    def process(self, graph: TemporalGraph) -> TemporalGraph:
        e, keys = graph.edges, (graph.src, graph.tgt, graph.t)
        if self.remove_self_loops:
            e = structure.drop_self_loops(e, graph.src, graph.tgt)
        if self.directionality == "undirected":
            e = structure.with_reversed(e, graph.src, graph.tgt)
        if self.directionality != "directed":
            e = structure.canonical(e, graph.src, graph.tgt)
        if self.remove_duplicates or self.directionality == "undirected":
            e = structure.dedup(e, keys, (graph.edge_id,))
        out = graph.with_edges(e)
        if self.reindex_nodes:
            coded, nodes, _ = structure.reindex_nodes(e, graph.nodes, graph.node_id)
            out = out.with_edges(coded).with_nodes(nodes)
        return out.noting(**{k: v for k, v in vars(self).items()})


@dataclass
class NormalizeTime(Step):
    """Edge and node times as longs."""

    def validate(self, graph: TemporalGraph | None) -> None:
        super().validate(graph)
        timeline.check_time_column(graph.edges, graph.t)

    def process(self, graph: TemporalGraph) -> TemporalGraph:
        out = graph.with_edges(timeline.normalize_time(graph.edges, graph.t))
        if graph.nodes is not None and graph.node_t in graph.nodes.columns:
            out = out.with_nodes(timeline.normalize_time(graph.nodes, graph.node_t))
        return out.noting(is_timestamp_normalized=True)


@dataclass
class SplitByTime(Step):
    """Quantile split of edges, and of nodes that carry a time."""

    train: float = 0.5
    val: float = 0.25

    def validate(self, graph: TemporalGraph | None) -> None:
        super().validate(graph)
        timeline.check_ratios(self.train, self.val)
        timeline.check_time_column(graph.edges, graph.t)
        if "split" in graph.edges.columns:
            raise ValueError("edges are already split")

    def process(self, graph: TemporalGraph) -> TemporalGraph:
        out = graph.with_edges(timeline.split_by_quantile(graph.edges, graph.t, self.train, self.val))
        return out.noting(train_ratio=self.train, val_ratio=self.val)


@dataclass
class NormalizeFeatures(Step):
    """Fit scalers and vectorisers on train rows and apply them."""

    specs: Sequence[Mapping[str, Any]] = field(default_factory=list)

    def validate(self, graph: TemporalGraph | None) -> None:
        super().validate(graph)
        for spec in self.specs:
            table = graph.nodes if spec.get("target") == "node" else graph.edges
            if table is None:
                raise ValueError("there is no node table")
            structure.check_columns(table, *spec["columns"])

    def process(self, graph: TemporalGraph) -> TemporalGraph:
        edges, nodes = features.normalize_features(graph.edges, graph.nodes, self.specs)
        return graph.with_edges(edges).with_nodes(nodes)


STEPS: dict[str, type[Step]] = {
    c.__name__: c for c in (Load, CleanStructure, NormalizeTime, SplitByTime, NormalizeFeatures)
}


class Chain:
    """Steps in order, optionally cached after each."""

    def __init__(self, steps: Sequence[Step], cache: StepCache | None = None) -> None:
        self.steps, self.cache = list(steps), cache

    @classmethod
    def from_config(
        cls, config: Sequence[Mapping[str, Any]], cache: StepCache | None = None, **shared: Any
    ) -> Chain:
        """Build from ``[{"name": ..., "params": {...}}, ...]``."""
        steps = []
        for entry in config:
            if entry["name"] not in STEPS:
                raise ValueError(f"unknown step '{entry['name']}'")
            kind = STEPS[entry["name"]]
            params = dict(entry.get("params", {}))
            if kind is Load:
                params.update(shared)
            steps.append(kind(**params))
        return cls(steps, cache)

    def add_step(self, step: Step) -> Chain:
        """Append, or replace the step of the same type."""
        for i, old in enumerate(self.steps):
            if type(old) is type(step):
                self.steps[i] = step
                return self
        self.steps.append(step)
        return self

    def run(self, graph: TemporalGraph | None = None, spark: SparkSession | None = None) -> TemporalGraph:
        done: list[dict[str, Any]] = []
        for i, step in enumerate(self.steps):
            done.append(step.parameters())
            if self.cache is None:
                graph = step(graph)
            else:
                make: Callable[[], TemporalGraph] = lambda step=step, graph=graph: step(graph)
                session = spark or (graph.edges.sparkSession if graph else step.spark)
                cached = self.cache.run(i, done, session, make)
                names = {k: getattr(graph, k) for k in ("src", "tgt", "t", "edge_id", "node_id", "node_t")} if graph else {}
                if isinstance(step, Load):
                    names["t"] = "timestamp"
                graph = TemporalGraph(cached.edges, cached.nodes, metadata=cached.metadata, **names)
        return graph


def clean(graph: TemporalGraph, train: float = 0.5, val: float = 0.25) -> TemporalGraph:
    """The usual chain: canonical edges, long times, quantile split."""
    return Chain([CleanStructure(), NormalizeTime(), SplitByTime(train, val)]).run(graph)


def split_counts(graph: TemporalGraph):
    return graph.edges.groupBy("split").agg(F.count("*").alias("edges"))
