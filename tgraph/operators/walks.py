"""Random walks, reservoirs and walk embeddings.

All walkers advance together, one join per step; choices are fixed by the
walker's number and the step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.functions.random import pick, u01
from tgraph.operators.graphstats import _union
from tgraph.operators.ordering import group_position
from tgraph.session import materialize


def indexed_neighbors(adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours numbered from 0 per node, and each node's number of them."""
    pairs = adj.select("node", "nbr").distinct()
    table = group_position(pairs, ["node"], ["nbr"], "idx")
    table = materialize(table.withColumn("idx", F.col("idx") - 1), "neighbors")
    return table, materialize(table.groupBy("node").agg(F.count("*").alias("deg")), "degrees")


def walkers(nodes: DataFrame, per_node: int) -> DataFrame:
    """``per_node`` walkers (walk, start) on every node (column node)."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))
    out = nodes.select("node", rounds.alias("_r"))
    return out.select(F.concat_ws("-", "node", "_r").alias("walk"), F.col("node").alias("start"))


def random_walks(
    start: DataFrame,
    neighbors: DataFrame,
    degrees: DataFrame,
    length: int,
    restart: float = 0.0,
    seed: object = 0,
    cut_every: int = 4,
) -> DataFrame:
    """Uniform walks of ``length`` nodes; with ``restart`` back to the start.

    A walker on a node without neighbours stays there.
    """
    state = start.select("walk", "start", F.col("start").alias("tip"), F.array("start").alias("path"))
    sizes = degrees.select(F.col("node").alias("tip"), "deg")
    table = neighbors.select(F.col("node").alias("tip"), "idx", "nbr")
    for step in range(1, length):
        sized = state.join(sizes, "tip", "left")
        back = u01(seed, F.lit("r"), "walk", F.lit(step)) < F.lit(float(restart))
        sized = sized.withColumn("_back", back).withColumn(
            "idx", pick(F.col("deg"), seed, F.lit("n"), "walk", F.lit(step))
        )
        moved = sized.join(table, ["tip", "idx"], "left")
        nxt = (
            F.when(F.col("deg").isNull(), F.col("tip"))
            .when(F.col("_back"), F.col("start"))
            .otherwise(F.col("nbr"))
        )
        state = moved.select("walk", "start", nxt.alias("_n"), "path").select(
            "walk", "start", F.col("_n").alias("tip"), F.concat("path", F.array("_n")).alias("path")
        )
        if step % cut_every == 0 or step == length - 1:
            state = materialize(state, "walks")
    return state.select("walk", "start", "path")


def biased_walks(
    start: DataFrame,
    neighbors: DataFrame,
    degrees: DataFrame,
    length: int,
    p: float,
    q: float,
    seed: object = 0,
    tries: int = 8,
) -> DataFrame:
    """Second-order walks: weight 1/p back, 1 to shared neighbours, 1/q away.

    The next node is proposed uniformly and accepted with its weight over the
    largest weight, which gives the same distribution as weighting all
    neighbours, at a cost that does not grow with the degree.  Walks end on a
    node without neighbours.
    """
    top = max(1.0 / p, 1.0, 1.0 / q)
    sizes = degrees.select(F.col("node").alias("tip"), "deg")
    table = neighbors.select(F.col("node").alias("tip"), "idx", "nbr")
    linked = neighbors.select(F.col("node").alias("prev"), "nbr", F.lit(1).alias("_linked"))
    state = start.select(
        "walk", "start", F.lit(None).cast("bigint").alias("prev"), F.col("start").alias("tip"),
        F.array("start").alias("path"),
    )
    ended = []
    for step in range(1, length):
        state = materialize(state.join(sizes, "tip", "left"), "walks")
        stuck = state.filter(F.col("deg").isNull()).select("walk", "start", "path")
        ended.append(stuck)
        open_, moved, r = state.filter(F.col("deg").isNotNull()), [], 0
        while True:
            at = F.sequence(F.lit(r * tries), F.lit((r + 1) * tries - 1))
            cand = open_.withColumn("try", F.explode(at))
            cand = cand.withColumn("idx", pick(F.col("deg"), seed, F.lit("n"), "walk", F.lit(step), "try"))
            cand = cand.join(table, ["tip", "idx"]).join(linked, ["prev", "nbr"], "left")
            weight = (
                F.when(F.col("prev").isNull(), F.lit(top))
                .when(F.col("nbr") == F.col("prev"), F.lit(1.0 / p))
                .when(F.col("_linked") == 1, F.lit(1.0))
                .otherwise(F.lit(1.0 / q))
            )
            good = cand.filter(u01(seed, F.lit("a"), "walk", F.lit(step), "try") * F.lit(top) < weight)
            best = good.groupBy("walk").agg(F.min_by("nbr", "try").alias("_n"))
            done = materialize(open_.join(best, "walk"), "walks")
            moved.append(done)
            open_ = open_.join(done, "walk", "left_anti")
            if open_.isEmpty():
                break
            open_ = materialize(open_, "open")
            r += 1
        state = _union(moved).select(
            "walk", "start", F.col("tip").alias("prev"), F.col("_n").alias("tip"),
            F.concat("path", F.array("_n")).alias("path"),
        )
    return _union([*ended, state.select("walk", "start", "path")])


def refresh_walks(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """New walks plus the old ones that do not start at a touched node."""
    keep = old.join(touched.select(F.col("node").alias("start")).distinct(), "start", "left_anti")
    return keep.select("walk", "start", "path").unionByName(new.select("walk", "start", "path"))


def reservoir(
    train: DataFrame, arriving: DataFrame, size: int, seed: object = 0
) -> DataFrame:
    """Fixed-size neighbour samples (node, slot, nbr) after a batch of edges.

    Slots start as uniform draws from the train neighbours.  Each neighbour
    new to a node raises its count to n and takes every slot whose draw of
    1..n hits n, so the last hit of a slot stays.  Neighbours count once, when
    first seen; the streaming version keeps the exact arrival state.
    """
    table, degrees = indexed_neighbors(train.select(F.col("src").alias("node"), F.col("tgt").alias("nbr")).unionByName(
        train.select(F.col("tgt").alias("node"), F.col("src").alias("nbr"))
    ))
    slots = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot")
    first = degrees.select("node", "deg", slots)
    first = first.withColumn("idx", pick(F.col("deg"), seed, F.lit("init"), "node", "slot"))
    start = first.join(table, ["node", "idx"]).select("node", "slot", "nbr", F.lit(0).cast("bigint").alias("n"))

    both = F.array(
        F.struct(F.col("src").alias("node"), F.col("tgt").alias("nbr")),
        F.struct(F.col("tgt").alias("node"), F.col("src").alias("nbr")),
    )
    seen = arriving.select(F.explode(both).alias("e"), "edge_pos").select("e.node", "e.nbr", "edge_pos")
    fresh = seen.groupBy("node", "nbr").agg(F.min("edge_pos").alias("edge_pos"))
    fresh = fresh.join(table.select("node", "nbr"), ["node", "nbr"], "left_anti")
    numbered = group_position(fresh, ["node"], ["edge_pos", "nbr"], "rn")
    counted = numbered.join(degrees, "node", "left").na.fill(0, ["deg"])
    hits = counted.select("node", "nbr", (F.col("deg") + F.col("rn")).alias("n"), slots)
    hits = hits.filter(pick(F.col("n"), seed, F.lit("hit"), "node", "n", "slot") == F.col("n") - 1)
    both_rows = start.unionByName(hits.select("node", "slot", "nbr", "n"))
    return both_rows.groupBy("node", "slot").agg(F.max_by("nbr", "n").alias("nbr"))


def reservoir_walks(
    table: DataFrame, start: DataFrame, size: int, length: int, restart: float = 0.0, seed: object = 0
) -> DataFrame:
    """Walks that move through the reservoir's slots instead of all edges."""
    neighbors = table.select("node", F.col("slot").cast("bigint").alias("idx"), "nbr")
    degrees = table.select("node").distinct().withColumn("deg", F.lit(size).cast("bigint"))
    return random_walks(start, neighbors, degrees, length, restart, seed)


def walk_embeddings(walks: DataFrame, nodes: DataFrame, size: int = 16, window: int = 5, seed: int = 1) -> DataFrame:
    """Skip-gram vectors of nodes; nodes on no walk get the mean vector."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    text = walks.select(F.transform("path", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(
        vectorSize=size, minCount=0, windowSize=window, seed=seed, inputCol="words", outputCol="v"
    ).fit(text)
    vectors = model.getVectors().select(
        F.col("word").cast("bigint").alias("node"), vector_to_array("vector").alias("vec")
    )
    mean = vectors.agg(F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(size)]).alias("m")).first()["m"]
    default = F.array(*[F.lit(float(x)) for x in mean])
    return nodes.join(vectors, "node", "left").select("node", F.coalesce("vec", default).alias("vec"))
