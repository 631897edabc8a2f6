"""Personalised-PageRank proximity and edge contexts, per snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.operators.graphstats import nearest_hops, symmetric_adjacency
from tgraph.operators.ordering import group_position
from tgraph.session import materialize

UNREACHABLE = 99


def directed_weights(edges: DataFrame, on: str = "snapshot_id") -> DataFrame:
    """``w / sqrt(r_i r_j)`` with out-weight sums r; 0 where a sum is 0."""
    w = edges.groupBy(on, F.col("src").alias("node"), F.col("tgt").alias("nbr")).agg(
        F.count("*").cast("double").alias("w")
    )
    out = w.groupBy(on, "node").agg(F.sum("w").alias("r"))
    other = out.select(on, F.col("node").alias("nbr"), F.col("r").alias("r2"))
    both = w.join(out, [on, "node"]).join(other, [on, "nbr"])
    return both.select(on, "node", "nbr", (F.col("w") / F.sqrt(F.col("r") * F.col("r2"))).alias("w"))


def proximity(
    weights: DataFrame, roots: DataFrame, c: float = 0.15, tolerance: float = 1e-12, floor: float = 0.0, on: str = "snapshot_id"
) -> DataFrame:
    """Rows of ``c (I - (1-c) A)^-1`` for the given roots, as a power series.

    Zero diagonal, each row scaled to sum 1. Terms are added until none has an
    entry above ``tolerance``; entries of a term up to ``floor`` are dropped.
    """
    step = materialize(weights, "weights")
    x = roots.select(on, "root", F.col("root").alias("node"), F.lit(c).alias("m"))
    total, term, n = None, x, 0
    while True:
        moved = term.join(step, [on, "node"]).groupBy(on, "root", F.col("nbr").alias("_n")).agg(
            (F.sum(F.col("m") * F.col("w")) * F.lit(1.0 - c)).alias("m")
        )
        term = materialize(
            moved.filter(F.col("m") > floor).select(on, "root", F.col("_n").alias("node"), "m"), "term"
        )
        largest = term.agg(F.max("m").alias("m")).first()["m"]
        if largest is None:
            break
        total = term if total is None else total.unionByName(term)
        if largest <= tolerance:
            break
        n += 1
        if n % 8 == 0:
            total = materialize(total.groupBy(on, "root", "node").agg(F.sum("m").alias("m")), "mass")
    if total is None:
        return x.filter(F.lit(False)).select(on, "root", "node", F.col("m").alias("p"))
    mass = total.filter(F.col("root") != F.col("node")).groupBy(on, "root", "node").agg(F.sum("m").alias("m"))
    rows = mass.groupBy(on, "root").agg(F.sum("m").alias("s"))
    return mass.join(rows, [on, "root"]).select(on, "root", "node", (F.col("m") / F.col("s")).alias("p"))


def edge_context(
    edges: DataFrame, prox: DataFrame, k: int, width: int = 1, on: str = "snapshot_id"
) -> DataFrame:
    """Both ends plus the k nodes closest to them, per look-back snapshot.

    Columns: edge_pos, lookback, rank (0 for the ends), node, hop (from the
    nearer end; 99 if unreachable).  Nodes without proximity are not listed.
    Hops are searched between an edge's ends and its members only.
    """
    e = edges.filter(F.col(on) >= width - 1).select("edge_pos", on, "src", "tgt")
    views = e.withColumn("lookback", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    views = views.withColumn("_s", F.col(on) - F.col("lookback"))
    ends = views.select("edge_pos", "lookback", "_s", "src", "tgt", F.explode(F.array("src", "tgt")).alias("root"))
    p = prox.select(F.col(on).alias("_s"), "root", "node", "p")
    # rounded, so that equal sums tie and the smaller id comes first
    near = (
        ends.join(p, ["_s", "root"])
        .filter((F.col("node") != F.col("src")) & (F.col("node") != F.col("tgt")))
        .groupBy("edge_pos", "lookback", "_s", "src", "tgt", "node")
        .agg(F.round(F.sum("p"), 9).alias("p"))
    )
    near = materialize(near, "near")
    top = group_position(near, ["edge_pos", "lookback"], [F.col("p").desc(), "node"], "rank")
    top = materialize(top.filter(F.col("rank") <= k).drop("p"), "members")
    # edges with the same ends in one snapshot ask the same
    ask = top.select("edge_pos", "lookback", "_s", "rank", "node", F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"))
    asked = ask.select(F.col("_s").alias(on), "a", "b", "node", F.col("node").alias("member"), F.explode(F.array("a", "b")).alias("root"))
    hops = nearest_hops(symmetric_adjacency(edges, (on,)), asked, ["a", "b", "member"], (on,))
    hops = hops.select(F.col(on).alias("_s"), "a", "b", F.col("member").alias("node"), "hops")
    found = ask.join(hops, ["_s", "a", "b", "node"], "left")
    found = found.select("edge_pos", "lookback", "rank", "node", F.coalesce("hops", F.lit(UNREACHABLE)).alias("hop"))
    own = ends.select("edge_pos", "lookback", F.lit(0).cast("bigint").alias("rank"), F.col("root").alias("node"), F.lit(0).alias("hop"))
    return own.distinct().unionByName(found)


def context_arrays(context: DataFrame, role: Column | None = None) -> DataFrame:
    """Role, position, hop and time ids of each edge's context, in order."""
    role = F.lit(0) if role is None else role
    item = F.struct("lookback", "rank", "node", "hop", role.alias("role"))
    packed = context.groupBy("edge_pos").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return packed.select(
        "edge_pos",
        F.transform("l", lambda x: x["node"]).alias("nodes"),
        F.transform("l", lambda x: x["role"]).alias("role_ids"),
        F.transform("l", lambda x: x["rank"]).alias("position_ids"),
        F.transform("l", lambda x: x["hop"]).alias("hop_ids"),
        F.transform("l", lambda x: x["lookback"]).alias("time_ids"),
    )


def node_colors(adj: DataFrame, rounds: int = 0, start: int = 1) -> DataFrame:
    """Constant starting colours, refined by the multiset of neighbour colours.

    A refinement hashes the sum of hashed neighbour colours, which needs no
    list of a hub's neighbours.
    """
    colors = adj.select("node").distinct().withColumn("color", F.lit(start).cast("bigint"))
    links = adj.select("node", "nbr").distinct()
    for _ in range(rounds):
        near = links.join(colors.select(F.col("node").alias("nbr"), "color"), "nbr")
        mixed = near.groupBy("node").agg(
            F.sum(F.pmod(F.xxhash64("color"), F.lit(2**40))).alias("_h"), F.count("*").alias("_n")
        )
        colors = materialize(
            colors.join(mixed, "node").select("node", F.xxhash64("color", "_h", "_n").alias("color")), "colors"
        )
    return colors

