"""Temporal-graph analytics as PySpark DataFrame operators."""

from tgraph.plans.graph import TemporalGraph

__all__ = ["TemporalGraph"]
