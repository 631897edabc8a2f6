"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest one known there."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them.

    Here ``a > b`` in every row, as the large star leaves it.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = low.select("a", F.col("m").alias("b"))
    rest = edges.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(rest).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns (id, component): the smallest id reachable by links.

    Only ids that have a link to another id are listed. Links may be repeated,
    in either direction; nulls and self-links are ignored. Minima are formed
    by partial aggregation, so a hub costs no more than its rows; every round
    is written to the checkpoint folder, and the loop ends at the fixpoint.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct(), "links")
    seen = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(state):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        seen = tuple(state)
