"""Neighbourhood propagation of node vectors (arrays of a fixed size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.functions.scores import time_encoding
from tgraph.session import materialize


def _vector(column: str, size: int, item) -> Column:
    return F.array(*[item(F.get(column, F.lit(i))) for i in range(size)])


def propagate(vectors: DataFrame, weights: DataFrame, size: int, layers: int = 1) -> DataFrame:
    """x <- A x per layer; nodes without neighbours keep x.

    ``vectors`` is (node, vec), ``weights`` (node, nbr, w).  Sums are one
    aggregate per position with a map-side part, so a hub's rows are combined
    before the shuffle.
    """
    x = vectors.select("node", "vec")
    for _ in range(layers):
        near = weights.join(x.select(F.col("node").alias("nbr"), F.col("vec").alias("v")), "nbr")
        sums = [F.sum(F.col("w") * F.get("v", F.lit(i))) for i in range(size)]
        moved = near.groupBy("node").agg(F.array(*sums).alias("_y"))
        x = x.join(moved, "node", "left").select("node", F.coalesce("_y", "vec").alias("vec"))
        if layers > 1:
            x = materialize(x, "propagated")
    return x


def mean_neighbors(vectors: DataFrame, adj: DataFrame, size: int) -> DataFrame:
    """Mean of the neighbours' vectors."""
    near = adj.select("node", "nbr").join(
        vectors.select(F.col("node").alias("nbr"), F.col("vec").alias("v")), "nbr"
    )
    means = [F.avg(F.get("v", F.lit(i))) for i in range(size)]
    return near.groupBy("node").agg(F.array(*means).alias("vec"))


def scatter(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sum, mean and softmax share of a value per node.

    The softmax joins each row to its node's maximum and sum; both are
    combined on the map side.
    """
    top = rows.groupBy(key).agg(F.max(value).alias("_max"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    powered = rows.join(top, key).withColumn("_e", F.exp(F.col(value) - F.col("_max")))
    sums = powered.groupBy(key).agg(F.sum("_e").alias("_s"))
    return powered.join(sums, key).select(
        *rows.columns, "total", "mean", (F.col("_e") / F.col("_s")).alias("softmax")
    )


def temporal_features(recent: DataFrame, queries: DataFrame, size: int, unit: float = 1e6) -> DataFrame:
    """Mean and sum of time encodings of each query's recent neighbours.

    ``recent`` is (qid, nbr_t); the encoded time is the age at the query in
    seconds (``unit`` ticks).
    """
    aged = recent.join(queries.select("qid", "t"), "qid")
    age = (F.col("t") - F.col("nbr_t")).cast("double") / F.lit(unit)
    coded = aged.select("qid", time_encoding(age, size, 1.5, log=True).alias("e"))
    return coded.groupBy("qid").agg(
        F.array(*[F.avg(F.get("e", F.lit(i))) for i in range(size)]).alias("mean"),
        F.array(*[F.sum(F.get("e", F.lit(i))) for i in range(size)]).alias("total"),
    )


def short_term_attention(states: DataFrame, key: str, order: str, size: int, weights: list[float]) -> DataFrame:
    """Weighted sum of the last states of a key, the newest weighted first.

    A state at position n is sent to positions n .. n+w-1, which bounds the
    rows and needs no window over a key; positions are gap-free per key.
    """
    if not weights:
        raise ValueError("there must be at least one weight")
    sent = states.select(
        key, F.posexplode(F.array(*[F.lit(float(x)) for x in weights])).alias("_lag", "_w"), order, "vec"
    ).select(key, (F.col(order) + F.col("_lag")).alias(order), "_w", F.col("vec").alias("v"))
    sums = [F.sum(F.col("_w") * F.get("v", F.lit(i))) for i in range(size)]
    mixed = sent.groupBy(key, order).agg(F.array(*sums).alias("mixed"), F.sum("_w").alias("_total"))
    out = states.join(mixed, [key, order])
    scaled = F.transform("mixed", lambda x: x / F.col("_total"))
    return out.select(*states.columns, scaled.alias("short_term"))
