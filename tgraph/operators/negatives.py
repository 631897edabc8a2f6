"""Negative-edge samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.functions.random import pick, u01
from tgraph.operators.ordering import running
from tgraph.operators.sampling import non_edges, observed_pairs, product_sample
from tgraph.operators.structure import nodes_of


def per_snapshot(edges: DataFrame, num_nodes: int, seed: object, upper: bool = False) -> DataFrame:
    """One non-edge per edge, absent from the edge's own snapshot."""
    slots = edges.select(F.col("edge_pos").alias("slot"), "snapshot_id")
    taken = observed_pairs(edges, extra=["snapshot_id"])
    return non_edges(slots, num_nodes, taken, seed, on=["snapshot_id"], upper=upper)


def first_seen(edges: DataFrame) -> DataFrame:
    """First snapshot of each unordered pair."""
    return (
        edges.groupBy(F.least("src", "tgt").alias("lo"), F.greatest("src", "tgt").alias("hi"))
        .agg(F.min("snapshot_id").alias("since"))
    )


def against_history(edges: DataFrame, num_nodes: int, seed: object) -> DataFrame:
    """One non-edge per edge, absent from everything up to its snapshot."""
    slots = edges.select(F.col("edge_pos").alias("slot"), "snapshot_id")
    return non_edges(slots, num_nodes, first_seen(edges), seed, since="since", max_tries=248)


def corrupt_endpoint(edges: DataFrame, num_nodes: int, seed: object) -> DataFrame:
    """Replace one random end of each edge by a random node."""
    other = pick(num_nodes, seed, F.lit("node"), "edge_pos")
    left = u01(seed, F.lit("side"), "edge_pos") < F.lit(0.5)
    return edges.withColumns(
        {
            "src": F.when(left, other).otherwise(F.col("src")),
            "tgt": F.when(left, F.col("tgt")).otherwise(other),
        }
    )


def first_unseen_node(edges: DataFrame, num_nodes: int) -> DataFrame:
    """Per snapshot, the smallest node id not seen up to then (or N).

    Only the smallest id per first-seen snapshot can matter, so the running
    minimum is over one row per snapshot.
    """
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("v"), "snapshot_id")
    seen = ends.groupBy("v").agg(F.min("snapshot_id").alias("at"))
    ids = edges.sparkSession.range(num_nodes).withColumnRenamed("id", "v")
    never = ids.join(seen, "v", "left_anti").agg(F.min("v").alias("m")).first()["m"]
    never = num_nodes if never is None else never
    snaps = edges.select("snapshot_id").distinct()
    firsts = seen.groupBy(F.col("at").alias("snapshot_id")).agg(F.min("v").alias("_v"))
    table = snaps.join(firsts, "snapshot_id", "left").withColumn(
        "_v", F.coalesce("_v", F.lit(num_nodes))
    )
    suffix = running(table, [], [F.col("snapshot_id").desc()], {"_m": F.col("_v")}, how="min")
    later = suffix.select((F.col("snapshot_id")).alias("_s"), "_m")
    # unseen as of s: the smallest id first seen in a later snapshot
    ordered = running(
        snaps.withColumn("_one", F.lit(1).cast("bigint")), [], ["snapshot_id"], {"_k": F.col("_one")}
    )
    nxt = ordered.select(F.col("snapshot_id").alias("_s"), (F.col("_k") - 1).alias("_k"))
    joined = ordered.select("snapshot_id", "_k").join(nxt, "_k", "left").join(later, "_s", "left")
    bound = F.least(F.coalesce("_m", F.lit(num_nodes)), F.lit(never))
    return joined.select("snapshot_id", bound.alias("bound"))


def degree_weighted(edges: DataFrame, num_nodes: int, seed: object) -> DataFrame:
    """Keep one end of each edge, drawn by snapshot degree; re-draw the other.

    The target end is kept with probability d(src)/(d(src)+d(tgt)).  The new
    end is a node never joined to the kept one so far, below the first node id
    not seen yet; where there is none, any non-neighbour serves, and any other node
    for a node that has met all.
    """
    ends = edges.select("snapshot_id", F.explode(F.array("src", "tgt")).alias("v"))
    degree = ends.groupBy("snapshot_id", "v").agg(F.count("*").alias("d"))
    rows = edges.select(F.col("edge_pos").alias("slot"), "snapshot_id", "src", "tgt")
    for end in ("src", "tgt"):
        side = degree.select("snapshot_id", F.col("v").alias(end), F.col("d").alias(f"d_{end}"))
        rows = rows.join(side, ["snapshot_id", end])
    share = F.col("d_src") / (F.col("d_src") + F.col("d_tgt"))
    kept = F.when(u01(seed, F.lit("keep"), "slot") < share, F.col("tgt")).otherwise(F.col("src"))
    rows = rows.withColumn("kept", kept).join(first_unseen_node(edges, num_nodes), "snapshot_id")
    rows = rows.select("slot", "snapshot_id", "kept", "bound")
    history = first_seen(edges)
    low = non_edges(
        rows, num_nodes, history, seed, since="since", anchor="kept", below="bound", max_tries=120
    )
    done = low.filter(F.col("u").isNotNull())
    left = low.filter(F.col("u").isNull()).select("slot", "snapshot_id", "kept", "bound")
    if left.isEmpty():
        return done.drop("bound", "u")
    rest = non_edges(
        left, num_nodes, history, f"{seed}-any", since="since", anchor="kept", max_tries=56
    )
    last = pick(num_nodes - 1, f"{seed}-last", "slot")
    last = F.when(last >= F.col("kept"), last + 1).otherwise(last)
    rest = rest.withColumn("v", F.coalesce("v", last))
    return done.unionByName(rest).drop("bound", "u")


def random_pairs(edges: DataFrame, n: int, seed: object) -> DataFrame:
    """n independent draws of a source and a target from the observed ones."""
    return product_sample(
        edges.sparkSession, [("src", edges, "src"), ("tgt", edges, "tgt")], n, seed
    )


def train_pool(edges: DataFrame) -> DataFrame:
    """Nodes seen in train rows, the pool for negatives."""
    return nodes_of(edges.filter(F.col("split") == "train"))
