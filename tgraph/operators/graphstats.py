"""Graph statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.functions.random import pick, u01
from tgraph.session import materialize

DENSE_NODES = 2_000  # up to which a matrix of all nodes may be solved on the driver

# Roots of one search, a bit each, and links that one task may search (about 300 MB).
WORD, SEARCH_LINKS = 60, 8_000_000

TASK_LINKS = 2_000_000  # that one task may hold to find components (about 100 MB)

# For each of these nodes, the links and the numbers of a Krylov basis that one task may hold (4 M links, 24 M numbers).
SPARSE_LINKS, SPARSE_NUMBERS = 2_000, 12_000


def degrees(edges: DataFrame, name: str = "node_id") -> DataFrame:
    """Degree with multiplicity, both directions."""
    return edges.select(F.explode(F.array("src", "tgt")).alias(name)).groupBy(name).agg(
        F.count("*").alias("degree")
    )


def degree_stats(train: DataFrame, num_nodes: int) -> DataFrame:
    """Mean and population deviation of degrees, isolated ids included."""
    d = F.col("degree").cast("double")
    n = F.lit(float(num_nodes))
    mean, square = F.sum(d) / n, F.sum(d * d) / n
    return degrees(train).agg(
        mean.alias("mean_degree"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std_degree")
    )


def symmetric_adjacency(edges: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows (node, nbr, w) in both directions; w counts parallel edges."""
    pairs = edges.groupBy(
        *on, F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")
    ).agg(F.count("*").alias("w"))
    both = F.when(
        F.col("a") != F.col("b"),
        F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("nbr")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("nbr")),
        ),
    ).otherwise(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nbr"))))
    # a self-loop counts twice on the diagonal of A + A'
    weight = F.when(F.col("a") == F.col("b"), F.col("w") * 2).otherwise(F.col("w"))
    return pairs.select(*on, F.explode(both).alias("e"), weight.alias("w")).select(
        *on, "e.node", "e.nbr", "w"
    )


def normalized_adjacency(
    adj: DataFrame, how: str = "sym", on: tuple[str, ...] = (), self_loops: bool = False
) -> DataFrame:
    """Weights over degrees: ``row`` 1/d, ``sym`` 1/sqrt(d_i d_j); 0 for d = 0.

    Degrees are row sums, joined on the row end and, for ``sym``, on the other
    end too.
    """
    if self_loops:
        ids = adj.select(*on, "node").unionByName(adj.select(*on, F.col("nbr").alias("node"))).distinct()
        loops = ids.select(*on, "node", F.col("node").alias("nbr"), F.lit(1).cast("bigint").alias("w"))
        adj = adj.unionByName(loops).groupBy(*on, "node", "nbr").agg(F.sum("w").alias("w"))
    d = adj.groupBy(*on, "node").agg(F.sum("w").cast("double").alias("d"))
    out = adj.join(d, [*on, "node"])
    if how == "row":
        return out.select(*on, "node", "nbr", (F.col("w") / F.col("d")).alias("w"))
    other = d.select(*on, F.col("node").alias("nbr"), F.col("d").alias("d2"))
    out = out.join(other, [*on, "nbr"], "left")
    w = F.when(F.col("d2") > 0, F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).otherwise(F.lit(0.0))
    return out.select(*on, "node", "nbr", w.alias("w"))


def symmetrize_max(adj: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Each direction gets the larger of both weights."""
    both = adj.select(*on, "node", "nbr", "w").unionByName(
        adj.select(*on, F.col("nbr").alias("node"), F.col("node").alias("nbr"), "w")
    )
    return both.groupBy(*on, "node", "nbr").agg(F.max("w").alias("w"))


def hop_distances(
    adj: DataFrame, roots: DataFrame, max_hops: int | None = None, on: tuple[str, ...] = ()
) -> DataFrame:
    """Hops from each root (on, root) to the nodes it reaches, the root at 0.

    A breadth-first search of all roots at once: a reached (root, node) is
    kept once, so the frontier never exceeds roots x nodes actually reached.
    """
    links = adj.select(*on, "node", "nbr").distinct()
    seen = materialize(
        roots.select(*on, "root", F.col("root").alias("node"), F.lit(0).alias("hops")), "bfs"
    )
    frontier, hop, parts = seen, 0, [seen]
    while max_hops is None or hop < max_hops:
        hop += 1
        step = (
            frontier.select(*on, "root", "node")
            .join(links, [*on, "node"])
            .select(*on, "root", F.col("nbr").alias("node"))
            .distinct()
        )
        for p in parts:
            step = step.join(p.select(*on, "root", "node"), [*on, "root", "node"], "left_anti")
        frontier = materialize(step.withColumn("hops", F.lit(hop)), "bfs")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > 8:
            parts = [materialize(_union(parts), "bfs")]
    return _union(parts)


def nearest_hops(adj: DataFrame, asked: DataFrame, group: list[str], on: tuple[str, ...] = ()) -> DataFrame:
    """Rows (on, group, hops): the least hops of any (root, node) pair of a group.

    ``asked`` has columns on, group, root and node. Both ends of every open pair
    are searched level by level, so a pair that lies d hops apart is met when the
    levels d/2 around its ends share a node; nothing is searched beyond that. For
    each pair the nodes of its smaller level are looked up in the other, so a hub's
    neighbours are not listed once a pair. A group is closed by the first pair
    met, a pair when the search around one of its ends is exhausted. Groups
    that no path joins are left out.
    """
    key = list(on)
    links = materialize(adj.filter(F.col("node") != F.col("nbr")).select(*key, "node", "nbr").distinct(), "links")
    pair = F.struct("root", "node")
    still = asked.groupBy(*key, *group).agg(F.collect_set(pair).alias("pairs"), F.max(F.col("root") == F.col("node")).alias("met"))
    still = materialize(still, "asked")
    parts = [still.filter("met").select(*key, *group, F.lit(0).alias("hops"))]
    # per side, the last two levels around the ends of open pairs: (on, end, at); the first level is that of all nodes
    first = links.select(*key, F.col("node").alias("end"), F.col("nbr").alias("at"))
    own = links.select(*key, F.col("node").alias("end"), F.col("node").alias("at")).distinct()
    sides = {"root": (first, own), "node": (first, own)}
    hop = 0
    while True:
        hop += 1
        still = still.filter("not met").select(*key, *group, F.explode("pairs").alias("p")).select(*key, *group, "p.root", "p.node")
        if still.isEmpty():
            return _union(parts)
        pairs = still.select(*key, "root", "node").distinct()
        side = "root" if hop % 2 else "node"
        if hop > 2:
            level, before = sides[side]
            ends = pairs.select(*key, F.col(side).alias("end")).distinct()
            step = level.join(ends, [*key, "end"], "left_semi").join(links.withColumnRenamed("node", "at"), [*key, "at"])
            step = step.select(*key, "end", F.col("nbr").alias("at")).distinct()
            # a neighbour of a level is in it, in the one before, or in the next
            for known in (level, before):
                step = step.join(known, [*key, "end", "at"], "left_anti")
            sides[side] = (materialize(step, "level"), level)
        if hop == 1:
            met = pairs.join(links.withColumnsRenamed({"node": "root", "nbr": "node"}), [*key, "root", "node"], "left_semi")
            met = met.withColumn("_met", F.lit(True))
        else:
            met = _met(pairs, sides["root"][0], sides["node"][0], key)
        # pairs of an exhausted end are in no row of ``met``
        judged = still.join(met, [*key, "root", "node"], "left" if hop == 1 else "inner")
        judged = judged.groupBy(*key, *group).agg(F.collect_list(pair).alias("pairs"), F.max(F.coalesce("_met", F.lit(False))).alias("met"))
        still = materialize(judged, "open")
        parts.append(still.filter("met").select(*key, *group, F.lit(hop).alias("hops")))
        if len(parts) > 16:
            parts = [materialize(_union(parts), "met")]


def _met(pairs: DataFrame, roots: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Pairs whose levels are both not empty, and whether they share a node.

    The nodes of the smaller level are looked up in the other.
    """
    levels = roots.withColumn("_side", F.lit(0)).unionByName(nodes.withColumn("_side", F.lit(1)))
    sizes = levels.groupBy(*key, "_side", "end").agg(F.count("*").alias("_n"))
    for i, end in enumerate(("root", "node")):
        own = sizes.filter(F.col("_side") == i).select(*key, F.col("end").alias(end), F.col("_n").alias(f"_{end}"))
        pairs = pairs.join(own, [*key, end])
    less = F.col("_root") <= F.col("_node")
    pairs = pairs.select(
        *key, "root", "node", F.when(less, 0).otherwise(1).alias("_side"), F.when(less, F.col("root")).otherwise(F.col("node")).alias("end"),
        F.when(less, F.col("node")).otherwise(F.col("root")).alias("_far"),
    )
    listed = pairs.join(levels, [*key, "_side", "end"])
    far = levels.select(*key, (1 - F.col("_side")).alias("_side"), F.col("end").alias("_far"), "at", F.lit(True).alias("_met"))
    return listed.join(far, [*key, "_side", "_far", "at"], "left").groupBy(*key, "root", "node").agg(F.max("_met").alias("_met"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def estimate_diameter(adj: DataFrame, num_nodes: int, sources: int = 500, seed: object = 0) -> float:
    """90th percentile of the farthest hop from random sources; 5.0 if none.

    Sources are drawn with replacement, and a repeated draw counts again.
    """
    draws = adj.sparkSession.range(sources).select(
        pick(num_nodes, seed, F.lit("bfs"), "id").alias("root")
    )
    # at most `sources` rows
    times = {r["root"]: r["_n"] for r in draws.groupBy("root").agg(F.count("*").alias("_n")).collect()}
    rows = [(far, times[root]) for root, far in farthest_hops(adj, sorted(times)).items()]
    if not rows:
        return 5.0
    rows = adj.sparkSession.createDataFrame(rows, "far int, _n bigint")
    rows = rows.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    return float(rows.agg(F.percentile("far", F.lit(0.9)).alias("p")).first()["p"])


def farthest_hops(adj: DataFrame, roots: list[int], task_links: int = SEARCH_LINKS) -> dict[int, int]:
    """Hops to the farthest node reached from each of a few distinct roots; those that reach none are left out.

    A node holds one bit a root, so a level reads each link once for all roots.
    Graphs of up to ``task_links`` counted links are searched in tasks of
    WORD roots each, larger ones in the cluster, by one join a level.
    """
    links = adj.filter(F.col("node") != F.col("nbr")).select("node", "nbr")
    links = materialize(links.distinct(), "links")
    words = [roots[at : at + WORD] for at in range(0, len(roots), WORD)]
    if links.count() > task_links:
        found = _hops_by_rounds(links, words)
    else:

        def search(part: pd.DataFrame) -> pd.DataFrame:
            word = words[int(part["word"].iloc[0])]
            return pd.DataFrame(_hops_in_task(part["node"].to_numpy(), part["nbr"].to_numpy(), word), columns=["root", "far"])

        # links are symmetric, so a task gets one direction
        each = links.filter("node < nbr").withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(len(words) - 1))))
        found = each.groupBy("word").applyInPandas(search, "root bigint, far int").collect()
    return {root: far for root, far in found if far}


def _hops_in_task(node: np.ndarray, nbr: np.ndarray, word: list[int]) -> list[tuple[int, int]]:
    ids, at = np.unique(np.concatenate([node, nbr]), return_inverse=True)
    # both directions, sorted by the row's end
    order = np.argsort(at, kind="stable")
    col = np.roll(at, len(node))[order]
    starts = np.searchsorted(at[order], np.arange(len(ids)))
    seen = np.zeros(len(ids), dtype=np.int64)
    for i, root in enumerate(word):
        k = int(np.searchsorted(ids, root))
        if k < len(ids) and ids[k] == root:
            seen[k] |= 1 << i
    front, far, hop = seen.copy(), [0] * len(word), 0
    while front.any():
        hop += 1
        front = np.bitwise_or.reduceat(front[col], starts) & ~seen
        seen |= front
        reached = int(np.bitwise_or.reduce(front))
        far = [hop if reached >> i & 1 else f for i, f in enumerate(far)]
    return list(zip(word, far))


def _hops_by_rounds(links: DataFrame, words: list[list[int]]) -> list[tuple[int, int]]:
    numbers = range(len(words))
    given = [(root, w, 1 << i) for w, word in enumerate(words) for i, root in enumerate(word)]
    given = links.sparkSession.createDataFrame(given, "node bigint, w int, bit bigint")
    own = given.groupBy("node").agg(*[F.coalesce(F.bit_or(F.when(F.col("w") == w, F.col("bit"))), F.lit(0)).alias(f"f{w}") for w in numbers])
    # as many rows as roots
    state = links.select("node").distinct().join(F.broadcast(own), "node", "left").na.fill(0)
    state = materialize(state.select("*", *[F.col(f"f{w}").alias(f"s{w}") for w in numbers]), "reached")
    far, hop = [[0] * len(word) for word in words], 0
    while True:
        hop += 1
        front = state.filter(" OR ".join(f"f{w} != 0" for w in numbers))
        front = front.select(F.col("node").alias("nbr"), *[f"f{w}" for w in numbers])
        near = links.join(front, "nbr").groupBy("node").agg(*[F.bit_or(f"f{w}").alias(f"n{w}") for w in numbers])
        new = [F.coalesce(f"n{w}", F.lit(0)).bitwiseAND(F.bitwise_not(f"s{w}")).alias(f"f{w}") for w in numbers]
        state = state.join(near, "node", "left").select("node", *new, *[F.col(f"s{w}") for w in numbers])
        state = state.select("node", *[f"f{w}" for w in numbers], *[F.col(f"s{w}").bitwiseOR(F.col(f"f{w}")).alias(f"s{w}") for w in numbers])
        state = materialize(state, "reached")
        reached = state.agg(*[F.bit_or(f"f{w}") for w in numbers]).first()
        if not any(reached):
            return [x for word, f in zip(words, far) for x in zip(word, f)]
        far = [[hop if bits >> i & 1 else f for i, f in enumerate(of)] for bits, of in zip(reached, far)]


def least_labels(row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """Smallest number of each number's component in the links given by their ends."""
    label = np.arange(n)
    while True:
        a, b = label[row], label[col]
        open_ = a != b
        if not open_.any():
            return label
        row, col, a, b = row[open_], col[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up


def _stars(on: tuple[str, ...], whole: bool, task_links: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function of batches that replaces their links by (on, node, label), ``task_links`` or more at a time.

    ``whole`` says that rows are sorted by ``on``, and takes the links of one group together.
    """
    names = [*on, "node", "label"]

    def solve(parts: list[pd.DataFrame]) -> pd.DataFrame:
        links = pd.concat(parts, ignore_index=True)
        group = links.groupby([*on], sort=False).ngroup().to_numpy() if on else np.zeros(len(links), dtype="int64")
        ids, at = np.unique(np.concatenate([links["node"].to_numpy(), links["nbr"].to_numpy()]), return_inverse=True)
        codes, at = np.unique(np.concatenate([group, group]) * len(ids) + at, return_inverse=True)
        label = least_labels(at[: len(links)], at[len(links) :], len(codes))
        out = pd.DataFrame({"node": ids[codes % len(ids)], "label": ids[codes[label] % len(ids)]})
        first = np.unique(group, return_index=True)[1]
        for c in on:
            out[c] = links[c].to_numpy()[first][codes // len(ids)]
        return out[names]

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for b in batches:
            while len(b):
                # held links of full tasks end where the next group begins
                more = np.ones(len(b), dtype=bool) if rows < task_links else np.zeros(len(b), dtype=bool)
                if whole and rows >= task_links and on:
                    last = held[-1].iloc[-1]
                    more = np.logical_and.reduce([(b[c] == last[c]).to_numpy() for c in on])
                if not more.any():
                    yield solve(held)
                    held, rows = [], 0
                    continue
                held.append(b[more])
                rows += int(more.sum())
                b = b[~more]
        if held:
            yield solve(held)

    return stars


def components(adj: DataFrame, on: tuple[str, ...] = (), task_links: int = TASK_LINKS) -> DataFrame:
    """Smallest node id of each node's connected component.

    Groups of up to ``task_links`` counted links are solved in tasks, many at once.
    In larger ones each task first replaces its own links by stars, then labels
    take the minimum over neighbours and jump to that label's own label, so that
    distances shrink faster than one hop a round.
    """
    links = adj.select(*on, "node", "nbr").na.drop().filter(F.col("node") <= F.col("nbr"))
    # links are symmetric, so one direction is enough
    links = materialize(links, "links")
    schema = links.select(*on, "node", F.col("node").alias("label")).schema
    sizes = links.groupBy(*on).agg(F.count("*").alias("_n"))
    large = materialize(sizes.filter(F.col("_n") > task_links).select(*on, F.lit(True).alias("_large")), "large")
    if large.isEmpty():
        placed = links.repartition(*on).sortWithinPartitions(*on) if on else links.repartition(1)
        return materialize(placed.mapInPandas(_stars(on, True, task_links), schema), "labels")
    if on:
        few = links.join(large.select(*on), [*on], "left_anti").repartition(*on).sortWithinPartitions(*on)
        few = few.mapInPandas(_stars(on, True, task_links), schema)
        links = links.join(large.select(*on), [*on], "left_semi")
    stars = links.mapInPandas(_stars(on, False, task_links), schema)
    labels = _by_rounds(stars, on)
    return materialize(labels.unionByName(few), "labels") if on else labels


def _by_rounds(stars: DataFrame, on: tuple[str, ...]) -> DataFrame:
    both = stars.select(*on, "node", F.col("label").alias("nbr"))
    both = both.unionByName(both.select(*on, F.col("nbr").alias("node"), F.col("node").alias("nbr")))
    links = materialize(both.distinct(), "links")
    labels = materialize(
        links.groupBy(*on, "node").agg(F.least(F.min("nbr"), F.col("node")).alias("label")), "labels"
    )
    while True:
        theirs = labels.select(*on, F.col("node").alias("nbr"), F.col("label").alias("l2"))
        near = links.join(theirs, [*on, "nbr"]).groupBy(*on, "node").agg(F.min("l2").alias("l2"))
        jump = labels.select(*on, F.col("node").alias("l2"), F.col("label").alias("l3"))
        step = labels.join(near, [*on, "node"]).withColumn("l2", F.least("label", "l2"))
        step = step.join(jump, [*on, "l2"]).select(
            *on, "node", F.col("label").alias("old"), F.least("l2", "l3").alias("label")
        )
        step = materialize(step, "labels")
        labels = step.select(*on, "node", "label")
        if step.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def label_propagation(adj: DataFrame) -> DataFrame:
    """Communities: each node takes its neighbours' heaviest label, until labels settle.

    A node counts its own label once; ties go to the smaller label. All nodes
    change at once, so labels can end in a cycle (of two rounds, as weights are
    symmetric); each node then keeps the smallest label it has in it.
    """
    links = adj.select("node", "nbr", "w")
    labels = materialize(links.select("node").distinct().withColumn("cluster", F.col("node")), "communities")
    rounds, seen = [], {}
    while True:
        digest = labels.agg(F.sum(F.xxhash64("node", "cluster").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("cluster", "node"))).first()
        if tuple(digest) in seen:
            break
        seen[tuple(digest)] = len(rounds)
        rounds.append(labels)
        votes = links.join(
            labels.select(F.col("node").alias("nbr"), "cluster"), "nbr"
        ).select("node", "cluster", "w")
        votes = votes.unionByName(labels.withColumn("w", F.lit(1).cast("bigint")))
        tally = votes.groupBy("node", "cluster").agg(F.sum("w").alias("w"))
        best = F.max_by("cluster", F.struct(F.col("w"), -F.col("cluster")))
        labels = materialize(tally.groupBy("node").agg(best.alias("cluster")), "communities")
    cycle = rounds[seen[tuple(digest)] :]
    for other in cycle[1:]:
        labels = labels.unionByName(other)
    return labels.groupBy(F.col("node").alias("node_id")).agg(F.min("cluster").alias("cluster"))


def triangles(adj: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Each triangle once (a, b, c).

    Edges point from lower to higher degree, which bounds the out-degree by
    the square root of twice the edge count, hubs included.
    """
    links = adj.filter(F.col("node") != F.col("nbr")).select(*on, "node", "nbr").distinct()
    deg = links.groupBy(*on, "node").agg(F.count("*").alias("d"))
    far = deg.select(*on, F.col("node").alias("nbr"), F.col("d").alias("d2"))
    up = links.join(deg, [*on, "node"]).join(far, [*on, "nbr"])
    up = up.filter(F.struct("d", "node") < F.struct("d2", "nbr"))
    up = materialize(up.select(*on, F.col("node").alias("a"), F.col("nbr").alias("b")), "oriented")
    second = up.select(*on, F.col("a").alias("b"), F.col("b").alias("c"))
    third = up.select(*on, "a", F.col("b").alias("c"))
    return up.join(second, [*on, "b"]).join(third, [*on, "a", "c"]).select(*on, "a", "b", "c")


def snapshot_properties(edges: DataFrame, on: str = "snapshot_id") -> DataFrame:
    """Size, density, degree, clustering, transitivity, assortativity, components."""
    key = (on,)
    adj = materialize(
        symmetric_adjacency(edges.filter(F.col("src") != F.col("tgt")), key), "adjacency"
    )
    deg = materialize(adj.groupBy(on, "node").agg(F.count("*").alias("d")), "degrees")
    tri = triangles(adj, key)
    per_node = (
        tri.select(on, F.explode(F.array("a", "b", "c")).alias("node"))
        .groupBy(on, "node")
        .agg(F.count("*").alias("tri"))
    )
    pairs = F.col("d") * (F.col("d") - 1) / F.lit(2.0)
    own = deg.join(per_node, [on, "node"], "left").na.fill(0, ["tri"])
    local = F.when(F.col("d") > 1, F.col("tri") / pairs).otherwise(F.lit(0.0))
    n = F.count("*")
    stats = own.groupBy(on).agg(
        n.alias("num_nodes"),
        (F.sum("d") / F.lit(2)).cast("bigint").alias("num_edges"),
        (F.sum("d") / (n * (n - 1))).alias("density"),
        F.avg("d").alias("average_degree"),
        F.avg(local).alias("clustering"),
        F.coalesce(F.try_divide(F.sum("tri").cast("double"), F.sum(pairs)), F.lit(0.0)).alias("transitivity"),
    )
    d2 = deg.select(on, F.col("node").alias("nbr"), F.col("d").cast("double").alias("d2"))
    ends = adj.join(deg.select(on, "node", F.col("d").cast("double").alias("d")), [on, "node"]).join(d2, [on, "nbr"])
    # null where all degrees are equal
    spread = F.sqrt(F.var_pop("d") * F.var_pop("d2"))
    mix = ends.groupBy(on).agg(F.try_divide(F.covar_pop("d", "d2"), spread).alias("assortativity"))
    parts = components(adj, key).groupBy(on).agg(F.countDistinct("label").alias("components"))
    return stats.join(mix, on).join(parts, on)


def krylov_eigenvalues(
    row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, k: int, steps: int, seed: object = 0, tol: float = 1e-6
) -> np.ndarray:
    """The k largest eigenvalues of (I + A) / 2, where A is given by its links.

    Lanczos with full orthogonalisation; a basis of ``steps`` vectors is restarted
    from its best ones until the residuals of k are at most ``tol``. A Krylov space
    has one vector of a multiple eigenvalue, so the search goes on from
    a new vector beside the settled ones until it adds no larger value.
    """
    draw = np.random.default_rng([*str(seed).encode()])
    order = np.argsort(row, kind="stable")
    row, col, w = row[order], col[order], w[order] / 2
    basis, small = np.empty((steps + 1, n)), np.zeros((steps, steps))

    def beside(y: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
        """``y`` without its parts along the basis, and those parts."""
        parts = np.zeros(held)
        for _ in range(2):
            h = basis[:held] @ y
            y = y - h @ basis[:held]
            parts += h
        return y, parts

    def fresh(held: int) -> np.ndarray:
        y, _ = beside(draw.standard_normal(n), held)
        return y / np.linalg.norm(y)

    basis[0], first, settled = fresh(0), 0, None
    while True:
        for j in range(first, steps):
            y = basis[j] / 2 + np.bincount(row, w * basis[j][col], n)
            y, h = beside(y, j + 1)
            small[j, : j + 1] = small[: j + 1, j] = h
            size = np.linalg.norm(y)
            basis[j + 1] = y / size if size > 1e-12 else fresh(j + 1)
            size = size if size > 1e-12 else 0.0
            if j + 1 < steps:
                small[j, j + 1] = small[j + 1, j] = size
        values, turn = np.linalg.eigh(small)
        values, turn = values[::-1], turn[:, ::-1]
        done = size * np.abs(turn[-1, :k]).max() <= tol
        if done and settled is not None and np.abs(values[:k] - settled).max() <= tol:
            return values[:k]
        kept = k if done else k + (steps - k) // 3
        for at in range(0, n, 1 << 16):
            part = basis[:steps, at : at + (1 << 16)]
            part[:kept] = turn[:, :kept].T @ part
        basis[kept] = fresh(kept) if done else basis[steps]
        small[:] = 0.0
        small[range(kept), range(kept)] = values[:kept]
        if done:
            settled = values[:k]
        first = kept


def leading_eigenvalues(
    adj: DataFrame, k: int, rounds: int = 100, seed: object = 0, tol: float = 1e-6, dense_nodes: int = DENSE_NODES
) -> np.ndarray:
    """The k largest eigenvalues of (I + A_sym) / 2, each within ``tol`` of one.

    Up to ``dense_nodes`` counted nodes the matrix is solved on the driver, up to
    SPARSE_LINKS times as many counted links in one task (``krylov_eigenvalues``).
    Above, a subspace with guard vectors is filtered by Chebyshev polynomials
    that damp the rest of the spectrum, until the residuals of its k leading
    vectors are below ``tol``; not so after ``rounds`` rounds is an error. Vectors
    live in the cluster as one array per node; the driver only sees matrices of
    the subspace's size.
    """
    links = materialize(normalized_adjacency(adj, "sym"), "normalized")
    nodes = materialize(links.select("node").distinct(), "nodes")
    n = nodes.count()
    k = min(k, n)
    if n <= dense_nodes:
        e = links.toPandas()
        ids, at = np.unique(np.concatenate([e["node"], e["nbr"]]), return_inverse=True)
        dense = np.eye(len(ids))
        np.add.at(dense, (at[: len(e)], at[len(e) :]), e["w"].to_numpy())
        return np.linalg.eigvalsh(dense / 2)[::-1][:k]
    if 4 * k < n and n * 3 * k <= SPARSE_NUMBERS * dense_nodes and links.count() <= SPARSE_LINKS * dense_nodes:
        steps = min(n - 1, SPARSE_NUMBERS * dense_nodes // n, 6 * k)

        def solve(batches):
            node, nbr, w = (np.concatenate(c) for c in zip(*((b["node"], b["nbr"], b["w"]) for b in batches)))
            ids, at = np.unique(np.concatenate([node, nbr]), return_inverse=True)
            yield pd.DataFrame({"value": krylov_eigenvalues(at[: len(w)], at[len(w) :], w, len(ids), k, steps, seed, tol)})

        found = links.select("node", "nbr", "w").repartition(1).mapInPandas(solve, "value double").collect()
        return np.sort([r["value"] for r in found])[::-1]

    def gram(df: DataFrame, left: str, right: str, rows: int, cols: int) -> np.ndarray:
        def part(batches):
            total = np.zeros((rows, cols))
            for b in batches:
                if len(b):
                    total += np.stack(b[left].to_numpy()).T @ np.stack(b[right].to_numpy())
            yield pd.DataFrame({"m": [total.ravel().tolist()]})

        kept = df.select(*dict.fromkeys([left, right])).mapInPandas(part, "m array<double>")
        sums = kept.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(rows * cols)
        out[[r["i"] for r in sums]] = [r["x"] for r in sums]
        return out.reshape(rows, cols)

    def rotate(df: DataFrame, m: np.ndarray, names: tuple[str, ...]) -> DataFrame:
        def part(batches):
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"node": b["node"], **{c: list(np.stack(b[c].to_numpy()) @ m) for c in names}})

        kept = df.select("node", *names)
        return materialize(kept.mapInPandas(part, kept.schema), "subspace")

    def moved(q: DataFrame, size: int) -> DataFrame:
        """Adds ``y``, the product of the matrix and ``q``."""
        near = links.join(q.select(F.col("node").alias("nbr"), "q"), "nbr").groupBy("node").agg(
            *[F.sum(F.col("w") * F.get("q", F.lit(i))).alias(f"_{i}") for i in range(size)]
        )
        y = F.array(*[(F.get("q", F.lit(i)) + F.col(f"_{i}")) / 2.0 for i in range(size)])
        return materialize(q.join(near, "node").select(*q.columns, y.alias("y")), "subspace")

    size = min(n, k + max(8, k // 2))
    cols = [u01(seed, F.lit(i), "node") - F.lit(0.5) for i in range(size)]
    q = materialize(nodes.withColumn("q", F.array(*cols)), "subspace")
    for _ in range(rounds):
        g = gram(q, "q", "q", size, size)
        scale = 1 / np.sqrt(np.diag(g))
        weight, basis = np.linalg.eigh(g * np.outer(scale, scale))
        full = weight > 1e-13 * weight[-1]
        q = moved(rotate(q, scale[:, None] * basis[:, full] / np.sqrt(weight[full]), ("q",)), size := int(full.sum()))
        if size < k:
            raise RuntimeError(f"the subspace fell to {size} of {k} directions")
        own, cross, square = (gram(q, a, b, size, size) for a, b in (("q", "q"), ("q", "y"), ("y", "y")))
        half = np.linalg.inv(np.linalg.cholesky(own))
        values, turn = np.linalg.eigh(half @ ((cross + cross.T) / 2) @ half.T)
        values, turn = values[::-1], half.T @ turn[:, ::-1]
        residual = np.sqrt(np.maximum(np.einsum("ij,ij->j", turn, square @ turn) - values**2, 0))[:k]
        if residual.max() <= tol:
            return values[:k]
        # the polynomial is 1 at the top and small from 0 to the last guard's value
        mid = max(values[-1], 1e-6) / 2
        above = (values[:k][residual > tol][0] - mid) / mid
        degree = int(np.clip(np.log(1e5) / np.arccosh(max(above, 1 + 1e-9)), 1, 20))
        q = rotate(q, turn, ("q", "y"))
        first = ratio = mid / (1 - mid)
        for i in range(degree):
            after = 1 / (2 / first - ratio) if i else first
            lead, back = F.lit((2 if i else 1) * after / mid), F.lit(ratio * after)
            step = F.zip_with("y", "q", lambda y, x: lead * (y - F.lit(mid) * x))
            if i:
                step = F.zip_with(step, "p", lambda s, x: s - back * x)
            q = q.select("node", F.col("q").alias("p"), step.alias("q"))
            q = moved(q, size) if i < degree - 1 else materialize(q, "subspace")
            ratio = after
    raise RuntimeError(f"eigenvalues not settled after {rounds} rounds: residual {residual.max():.1e} above {tol:.1e}")


def eigengap(adj: DataFrame, max_k: int = 50, fallback: int = 10, **kw: Any) -> int:
    """Number of communities from the largest gap of the Laplacian's spectrum."""
    n = adj.select("node").distinct().count()
    k = min(max_k + 1, n - 1)
    if k < 3:
        return fallback
    try:
        values = leading_eigenvalues(adj, k, **kw)
    except np.linalg.LinAlgError:
        return fallback
    laplacian = np.sort(2.0 - 2.0 * values)
    return int(np.argmax(np.diff(laplacian)[1:]) + 2)
