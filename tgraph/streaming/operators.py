"""Stream versions of snapshots, degrees, node memory and samples."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ends_of(edges: DataFrame, *extra: str) -> DataFrame:
    """Both directions of each edge as (node, nbr)."""
    both = F.array(
        F.struct(F.col("src").alias("node"), F.col("tgt").alias("nbr")),
        F.struct(F.col("tgt").alias("node"), F.col("src").alias("nbr")),
    )
    return edges.select(F.explode(both).alias("e"), *extra).select("e.node", "e.nbr", *extra)


def tumbling_snapshots(edges: DataFrame, size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Edges, and distinct-source estimate, per time window.

    Edges later than ``late`` behind the newest are dropped by the watermark.
    """
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = edges.withWatermark("ts", late).groupBy(w.alias("w")).agg(
        F.count("*").alias("edges"), F.min("t").alias("t_min"), F.max("t").alias("t_max")
    )
    return out.select(F.col("w.start").alias("start"), "edges", "t_min", "t_max")


def late_edges(edges: DataFrame, seen_until: str, late: str) -> DataFrame:
    """Edges that a watermark at ``seen_until`` would drop, for a side output."""
    return edges.filter(F.col("ts") < F.expr(f"timestamp'{seen_until}' - interval {late}"))


def session_runs(edges: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts per source: activity without a pause longer than ``gap``."""
    out = edges.withWatermark("ts", late).groupBy("src", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("edges"), F.min("t").alias("t_min"), F.max("t").alias("t_max")
    )
    return out.select("src", "edges", "t_min", "t_max")


def stream_degrees(edges: DataFrame) -> DataFrame:
    """Cumulative degree per node; counts combine before the shuffle."""
    return ends_of(edges).groupBy("node").agg(F.count("*").alias("degree"))


# --- node memory -----------------------------------------------------------

def node_memory(messages: DataFrame, size: int, half_life: float, span: float = 32.0) -> DataFrame:
    """Exponentially decayed sum of each node's messages.

    Input (node, t, msg).  Messages are summed in their growth since the start
    of their ``salt``, a stretch of ``span`` half-lives, which stays far from
    the limits of doubles; decayed sums can be added up later.  Sums combine before
    the shuffle, so a hub's messages do not meet in one task.  Emits the new
    sums of touched keys (node, salt), decayed to their last time; a message
    without time makes them NaN.
    """
    rate, ticks = math.log(2.0) / half_life, F.lit(half_life * span)
    t = F.col("t").cast("double")
    salted = messages.withColumn("salt", F.floor(t / ticks))
    growth = F.exp(F.lit(rate) * (t - F.col("salt") * ticks))
    salted = salted.withColumn("_k", F.coalesce(growth, F.lit(math.nan)))
    sums = [F.sum(F.get("msg", F.lit(i)).cast("double") * F.col("_k")).alias(f"_{i}") for i in range(size)]
    out = salted.groupBy("node", "salt").agg(
        F.coalesce(F.max(t), F.lit(-math.inf)).alias("last_t"), F.sum("_k").alias("_w"), F.count("*").alias("n"), *sums
    )
    decay = F.coalesce(F.exp(F.lit(rate) * (F.col("salt") * ticks - F.col("last_t"))), F.lit(1.0))
    return out.select(
        "node", "salt", "last_t", (F.col("_w") * decay).alias("weight"), "n", F.array(*[F.col(f"_{i}") * decay for i in range(size)]).alias("total")
    )


def merge_memory(parts: DataFrame, size: int, half_life: float) -> DataFrame:
    """Node states from salted parts, all decayed to the node's last time."""
    rate = math.log(2.0) / half_life
    last = parts.groupBy("node").agg(F.max("last_t").alias("_last"))
    aged = parts.join(last, "node").withColumn("_k", F.exp(F.lit(-rate) * (F.col("_last") - F.col("last_t"))))
    sums = [F.sum(F.get("total", F.lit(i)) * F.col("_k")) for i in range(size)]
    out = aged.groupBy("node").agg(
        F.max("_last").alias("last_t"), F.sum(F.col("weight") * F.col("_k")).alias("weight"),
        F.sum("n").alias("n"), F.array(*sums).alias("_t"),
    )
    state = F.transform("_t", lambda x: x / F.col("weight"))
    return out.select("node", "last_t", "n", "weight", state.alias("state"))


# --- samples ----------------------------------------------------------------


def draw(bound: int, *parts: object) -> int:
    """The integer ``pick`` draws for the same key."""
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(int(digest[:13], 16) / 2**52 * bound)


def reservoir_step(
    slots: list[int], degree: int, nbr: int, node: int, seed: object
) -> tuple[list[int], int]:
    """One arrival: unless held already, it takes each slot with chance 1/degree."""
    if nbr in slots:
        return slots, degree
    degree += 1
    hit = [draw(degree, seed, node, degree, i) == degree - 1 for i in range(len(slots))]
    return [nbr if h else s for s, h in zip(slots, hit)], degree


def stream_reservoir(edges: DataFrame, size: int, seed: object = 0) -> DataFrame:
    """Fixed-size neighbour sample per node, updated edge by edge.

    Free slots are -1.  A key's rows of one micro-batch are put in order
    first; the micro-batch limit bounds them.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, degree = ([-1] * size, 0)
        if state.exists:
            slots, degree = state.get
            slots = list(slots)
        rows = pd.concat(list(parts)).sort_values(["edge_pos", "nbr"])
        for nbr in rows["nbr"]:
            slots, degree = reservoir_step(slots, degree, int(nbr), int(key[0]), seed)
        state.update((slots, degree))
        yield pd.DataFrame({"node": [key[0]], "degree": [degree], "slots": [slots]})

    return ends_of(edges, "edge_pos").groupBy("node").applyInPandasWithState(
        update, "node bigint, degree bigint, slots array<bigint>", "slots array<bigint>, degree bigint",
        "update", GroupStateTimeout.NoTimeout,
    )


def stream_neighbors(edges: DataFrame, k: int) -> DataFrame:
    """The k latest interactions per node, oldest first."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        if state.exists:
            held = list(zip(*[list(x) for x in state.get]))
        for part in parts:
            held += list(zip(part["edge_pos"].astype(int), part["nbr"].astype(int)))
            held = sorted(held)[-k:]
        held = [(int(a), int(b)) for a, b in held]
        eids, nbrs = [a for a, _ in held], [b for _, b in held]
        state.update((eids, nbrs))
        yield pd.DataFrame({"node": [key[0]], "eids": [eids], "nbrs": [nbrs]})

    return ends_of(edges, "edge_pos").groupBy("node").applyInPandasWithState(
        update, "node bigint, eids array<bigint>, nbrs array<bigint>", "eids array<bigint>, nbrs array<bigint>",
        "update", GroupStateTimeout.NoTimeout,
    )


def rolling_scores(scored: DataFrame, size: int, shards: int = 16) -> DataFrame:
    """The latest ``size`` normal scores of each shard.

    The latest of all are among the latest of the shards; ``last_scores``
    merges them.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        if state.exists:
            held = list(zip(*[list(x) for x in state.get]))
        for part in parts:
            held += list(zip(part["edge_pos"].astype(int), part["score"].astype(float)))
            held = sorted(held)[-size:]
        eids, values = [int(a) for a, _ in held], [float(b) for _, b in held]
        state.update((eids, values))
        yield pd.DataFrame({"shard": [key[0]], "eids": [eids], "scores": [values]})

    normal = scored.filter(F.col("label") <= 0)
    sharded = normal.withColumn("shard", F.pmod(F.hash("edge_pos"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInPandasWithState(
        update, "shard int, eids array<bigint>, scores array<double>", "eids array<bigint>, scores array<double>",
        "update", GroupStateTimeout.NoTimeout,
    )


def last_scores(shards: DataFrame, size: int) -> DataFrame:
    """The latest ``size`` scores of all shards."""
    rows = shards.select(F.explode(F.arrays_zip("eids", "scores")).alias("z")).select(
        F.col("z.eids").alias("edge_pos"), F.col("z.scores").alias("score")
    )
    return rows.orderBy(F.col("edge_pos").desc()).limit(size)
