"""Labelled anomalous edges.

Generated edges have ``src, tgt, t, msg, label, split, group_id, w`` and are
drawn by hash, so a retried task gives the same edges.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tgraph.functions import arrays as ar
from tgraph.functions.random import permuted_range, pick, u01
from tgraph.operators.ordering import global_position, group_position, running, shifted
from tgraph.operators.sampling import (
    indexed,
    lookup,
    numbered_pairs,
    observed_pairs,
    smallest,
    unseen_pairs,
    weighted_pick,
)
from tgraph.session import materialize, maybe_broadcast

# Fixed values.
DURATIONS = {"small": 0.1, "medium": 0.5, "large": 1.0}
UNKNOWN_DURATION = 0.01
GROUP_TYPES = ("random", "burst", "clique", "path", "bridge")
TYPE_ALIASES = {
    "s": "structural",
    "t": "temporal",
    "c": "contextual",
    "sc": "structural-contextual",
    "tc": "temporal-contextual",
    "tsc": "temporal-structural-contextual",
}
ROW_TYPES = tuple(TYPE_ALIASES.values())
RANDOM_BATCH = 10


def duration_rate(duration: float | str) -> float:
    """Fraction of a split's time range; unknown names mean 0.01."""
    if isinstance(duration, str):
        return DURATIONS.get(duration, UNKNOWN_DURATION)
    return float(duration)


def _clamp(x: float, low: int, high: int) -> int:
    return max(low, min(int(x), high))


def group_size(kind: str, stats: Mapping[str, float]) -> int:
    """Nodes (clique, path) or edges (others) of one group."""
    if kind == "random":
        return RANDOM_BATCH
    if kind == "burst":
        return _clamp(stats["mean_degree"] + 3 * stats["std_degree"], 10, 100)
    if kind == "clique":
        return _clamp(math.sqrt(stats["avg_cluster_size"]) * 2, 4, 15)
    if kind == "path":
        return _clamp(stats["est_diameter"] + 1, 5, 20) + 1
    if kind == "bridge":
        return 1
    raise ValueError(f"unknown anomaly type '{kind}'")


def _distinct_nodes(num_nodes: int, k: int, seed: object) -> Column:
    """The first k distinct of 4k+8 draws, as an array in draw order."""
    draws = F.transform(
        F.sequence(F.lit(1), F.lit(4 * k + 8)), lambda i: pick(num_nodes, seed, F.lit("n"), "g", i)
    )
    return F.slice(F.array_distinct(draws), 1, k)


def _pair(u: Column, v: Column) -> Column:
    return F.struct(u.alias("u"), v.alias("v"))


def index_communities(communities: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Members numbered per cluster, clusters numbered with sizes, their count."""
    placed = group_position(communities.select("node_id", "cluster"), ["cluster"], ["node_id"], "m")
    members = materialize(placed, "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    sizes = global_position(sizes, ["cluster"], "c")
    k = sizes.count()
    if k < 2:
        raise ValueError("bridge needs at least two communities")
    return members, sizes, k


def candidate_edges(
    groups: DataFrame,
    kind: str,
    num_nodes: int,
    size: int,
    seed: object,
    communities: tuple[DataFrame, DataFrame, int] | None = None,
) -> DataFrame:
    """Edges ``(g, i, u, v)`` of numbered candidate groups, before any check.

    ``bridge`` needs ``communities`` as given by ``index_communities``.
    """
    if kind in ("random", "burst"):
        rows = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        u = pick(num_nodes, seed, F.lit("c"), "g")
        if kind == "random":
            u = pick(num_nodes, seed, F.lit("u"), "g", "i")
        return rows.select("g", "i", u.alias("u"), pick(num_nodes, seed, F.lit("v"), "g", "i").alias("v"))
    if kind in ("clique", "path"):
        rows = groups.withColumn("n", _distinct_nodes(num_nodes, size, seed))
        at = F.sequence(F.lit(1), F.size("n"))
        if kind == "clique":
            pairs = F.flatten(
                F.transform(
                    at,
                    lambda a: F.transform(
                        F.slice(F.col("n"), a + 1, F.size("n")),
                        lambda b: _pair(F.get("n", a - 1), b),
                    ),
                )
            )
        else:
            pairs = F.transform(
                F.filter(at, lambda a: a > 1),
                lambda a: _pair(F.get("n", a - 2), F.get("n", a - 1)),
            )
        return rows.select("g", F.posexplode(pairs).alias("i", "e")).select("g", "i", "e.u", "e.v")
    if kind == "bridge":
        members, sizes, k = communities
        first = pick(k, seed, F.lit("a"), "g")
        second = F.pmod(first + 1 + pick(k - 1, seed, F.lit("b"), "g"), F.lit(k))
        rows = groups.select("g", F.lit(0).alias("i"), first.alias("ca"), second.alias("cb"))
        for c, end in (("ca", "u"), ("cb", "v")):
            side = sizes.select(F.col("c").alias(c), F.col("cluster").alias("_k"), "size")
            rows = rows.join(maybe_broadcast(side), c)
            rows = rows.withColumn("m", pick(F.col("size"), seed, F.lit(end), "g") + 1)
            table = members.select(F.col("cluster").alias("_k"), "m", F.col("node_id").alias(end))
            rows = rows.join(table, ["_k", "m"]).drop("_k", "m", "size", c)
        return rows.select("g", "i", "u", "v")
    raise ValueError(f"unknown anomaly type '{kind}'")


def accept_groups(cand: DataFrame, observed: DataFrame, target: int) -> tuple[DataFrame, int]:
    """New edges of the first groups that reach ``target``, and their number.

    Self-loops and observed pairs go; of equal pairs the earliest stays.  A
    group is kept while the groups before it hold fewer than ``target`` edges,
    so the last one may overshoot.
    """
    fresh = cand.filter(F.col("u") != F.col("v")).withColumns(
        {"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}
    )
    fresh = fresh.join(observed, ["lo", "hi"], "left_anti")
    first = fresh.groupBy("lo", "hi").agg(
        F.min(F.struct("g", "i", "u", "v")).alias("f")
    )
    edges = materialize(first.select("f.*"), "accepted")
    sizes = edges.groupBy("g").agg(F.count("*").alias("n"))
    summed = running(sizes, [], ["g"], {"upto": F.col("n"), "group_id": F.lit(1).cast("bigint")})
    kept = summed.filter(F.col("upto") - F.col("n") < target).select("g", "group_id", "upto")
    reached = kept.agg(F.max("upto").alias("u"), F.max("group_id").alias("k")).first()
    return edges.join(kept.select("g", "group_id"), "g"), reached["u"] or 0


def last_messages(edges: DataFrame, msg: str = "msg") -> DataFrame:
    """The latest message each source sent."""
    return edges.groupBy("src").agg(F.max_by(msg, F.struct("t", "edge_pos")).alias("msg"))


def inject(
    edges: DataFrame,
    kind: str,
    ratios: Mapping[str, float],
    num_nodes: int,
    stats: Mapping[str, float] | None = None,
    duration: float | str = "medium",
    communities: DataFrame | None = None,
    seed: object = 0,
    msg_size: int | None = None,
) -> tuple[DataFrame, dict[str, Any]]:
    """Generate anomalous groups per split; returns new edges and a report.

    Splits run in the order train, val, test, and each split's new pairs count
    as observed in the next.  ``edges`` needs src, tgt, t, edge_pos, split and,
    for messages, ``msg``. Four times as many groups are drawn until a split has
    its edges, or two rounds on end find no further edge; the report then has
    fewer generated than requested.
    """
    if kind not in GROUP_TYPES:
        raise ValueError(f"unknown anomaly type '{kind}'")
    if kind == "bridge" and communities is None:
        raise ValueError("bridge needs communities(node_id, cluster)")
    spark = edges.sparkSession
    indexed_communities = index_communities(communities) if kind == "bridge" else None
    rate = duration_rate(duration)
    size = group_size(kind, stats or {})
    per_group = {"clique": size * (size - 1) // 2, "path": size - 1}.get(kind, size)
    observed = observed_pairs(edges)
    spans = {
        r["split"]: r
        for r in edges.groupBy("split")
        .agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
        .collect()  # one row per split
    }
    out, report, offset = None, {"type": kind, "duration_rate": rate, "splits": {}}, 0
    for split in ("train", "val", "test"):
        ratio = ratios.get(split, 0.0)
        target = int(spans[split]["n"] * ratio) if split in spans and ratio > 0 else 0
        report["splits"][split] = {"ratio": ratio, "requested": target, "generated": 0}
        if target == 0:
            continue
        salt = f"{seed}-{split}"
        n_groups = 2 * math.ceil(target / per_group) + 8
        before, idle = -1, 0
        while True:
            groups = spark.range(n_groups).withColumnRenamed("id", "g")
            cand = candidate_edges(groups, kind, num_nodes, size, salt, indexed_communities)
            new, made = accept_groups(cand, observed, target)
            if made >= target:
                break
            idle = idle + 1 if made == before else 0
            if idle == 2:
                break
            before, n_groups = made, n_groups * 4
        placed = _place(new, split, spans[split], rate, salt).withColumn(
            "group_id", F.col("group_id") + F.lit(offset)
        )
        placed = materialize(placed, "injected")
        top = placed.agg(F.max("group_id").alias("g"), F.count("*").alias("n")).first()
        offset = top["g"] or offset
        report["splits"][split]["generated"] = top["n"]
        observed = observed.unionByName(observed_pairs(placed))
        out = placed if out is None else out.unionByName(placed)
    report["total_generated"] = sum(s["generated"] for s in report["splits"].values())
    if out is None:
        raise ValueError("no split has a target above zero")
    if "msg" in edges.columns:
        out = out.join(last_messages(edges), "src", "left")
        if msg_size is not None:
            zeros = F.array(*[F.lit(0.0)] * msg_size)
            out = out.withColumn("msg", F.coalesce("msg", zeros))
    return out, report


def _place(new: DataFrame, split: str, span: Any, rate: float, seed: object) -> DataFrame:
    """Give each group a window in the split's range and sorted times in it.

    Groups are bounded by their type (at most 105 edges), so windows over one
    group are small.
    """
    lo, hi = float(span["lo"]), float(span["hi"])
    length = (hi - lo) * min(rate, 1.0)
    room = max(lo, hi - length) - lo
    start = F.lit(lo) + u01(seed, F.lit("start"), "g") * F.lit(room)
    drawn = new.withColumn("_t", start + u01(seed, F.lit("t"), "g", "i") * F.lit(length))
    by_i = Window.partitionBy("g").orderBy("i")
    times = F.array_sort(F.collect_list("_t").over(Window.partitionBy("g")))
    return drawn.withColumns({"_k": F.row_number().over(by_i), "_all": times}).select(
        F.col("u").alias("src"),
        F.col("v").alias("tgt"),
        F.get("_all", F.col("_k") - 1).alias("t"),
        F.lit(1).alias("label"),
        F.lit(split).alias("split"),
        "group_id",
        F.lit(1.0).alias("w"),
    )


def merge_injected(edges: DataFrame, injected: DataFrame) -> DataFrame:
    """Union with the input, labels made binary, times as double, re-ordered."""
    if "label" not in edges.columns:
        edges = edges.withColumn("label", F.lit(0))
    base = edges.withColumns(
        {
            "label": (F.col("label") != 0).cast("int"),
            "t": F.col("t").cast("double"),
            "group_id": F.lit(0).cast("bigint"),
            "w": F.lit(1.0),
        }
    ).drop("edge_pos")
    both = base.unionByName(injected.withColumn("label", F.col("label").cast("int")))
    return global_position(both, ["t", "src", "tgt", "group_id"])


def injection_summary(merged: DataFrame) -> DataFrame:
    """Per split: edges, injected edges, their groups and ratio."""
    made = F.count_if(F.col("group_id") > 0)
    return merged.groupBy("split").agg(
        F.count("*").alias("edges"),
        made.alias("generated"),
        F.countDistinct(F.when(F.col("group_id") > 0, F.col("group_id"))).alias("groups"),
        (made / (F.count("*") - made)).alias("ratio"),
    )


# --- time properties -----------------------------------------------------


def time_gaps(train: DataFrame, t: str = "t") -> DataFrame:
    """Distinct gaps between consecutive distinct train times, with counts."""
    times = global_position(train.select(t).distinct(), [t], "_p")
    gaps = shifted(times, "_p", {"_last": F.col(t)}, -1)
    return (
        gaps.filter(F.col("_last").isNotNull())
        .groupBy((F.col(t) - F.col("_last")).alias("delta"))
        .agg(F.count("*").alias("n"))
    )


def granularity(gaps: DataFrame) -> int:
    """Greatest common divisor of all gaps: per partition, then of those."""

    def per_part(parts):
        got = [np.gcd.reduce(p["delta"].to_numpy()) for p in parts if len(p)]
        if got:
            yield pd.DataFrame({"delta": [int(np.gcd.reduce(got))]})

    rows = gaps.select("delta").mapInPandas(per_part, "delta bigint").collect()
    return reduce(math.gcd, [r["delta"] for r in rows], 0) or 1


def time_deltas(train: DataFrame, t: str = "t") -> DataFrame:
    """Gaps with count, inverse-frequency probability and the granularity."""
    gaps = materialize(time_gaps(train, t), "gaps")
    weight = F.pow(F.col("n").cast("double"), F.lit(-1.5))
    total = gaps.agg(F.sum(weight).alias("s")).first()["s"] or 0.0
    return gaps.withColumns(
        {"p": weight / F.lit(total + 1e-10), "granularity": F.lit(granularity(gaps)).cast("bigint")}
    )


def plausible_times(
    slots: DataFrame, deltas: DataFrame, first: int, last: int, seed: object, max_steps: int = 15
) -> DataFrame:
    """A time per slot: a multiple of the granularity plus a walk over gaps.

    The walk has 1..max_steps-1 signed steps drawn by gap probability times
    gap count; the result is clipped to [first, last].
    """
    unit = deltas.agg(F.max("granularity").alias("g")).first()["g"] or 1
    low, high = -(-first // unit), last // unit
    if low > high:
        return slots.withColumn("new_t", F.lit(first))
    base = (F.lit(low) + pick(high - low + 1, seed, F.lit("base"), "slot")) * F.lit(unit)
    steps = F.lit(1) + pick(max_steps - 1, seed, F.lit("steps"), "slot")
    walk = slots.select("slot", F.explode(F.sequence(F.lit(1).cast("bigint"), steps)).alias("step"))
    walk = walk.withColumn("_u", u01(seed, F.lit("gap"), "slot", "step"))
    items = deltas.select("delta", (F.col("p") * F.col("n")).alias("_w"))
    walk = weighted_pick(walk, "_u", items, "_w", ["delta"])
    sign = F.when(u01(seed, F.lit("sign"), "slot", "step") < 0.5, -1).otherwise(1)
    moved = walk.groupBy("slot").agg(F.sum(F.col("delta") * sign).alias("_move"))
    out = slots.join(moved, "slot", "left")
    t = F.greatest(F.lit(first), F.least(F.lit(last), base + F.coalesce("_move", F.lit(0))))
    return out.withColumn("new_t", t.cast("bigint")).drop("_move")


# --- structural, temporal and contextual edges ---------------------------


def weighted_edges(edges: DataFrame, n: int, seed: object) -> DataFrame:
    """n edges drawn with replacement, rare pairs more often."""
    counts = edges.groupBy("src", "tgt").agg(F.count("*").alias("_n"))
    items = edges.join(counts, ["src", "tgt"]).withColumn(
        "_w", F.pow(F.col("_n").cast("double"), F.lit(-1.5))
    )
    draws = edges.sparkSession.range(n).select(
        F.col("id").alias("slot"), u01(seed, F.lit("edge"), "id").alias("_u")
    )
    out = weighted_pick(draws, "_u", items.drop("_n"), "_w", ["edge_pos"])
    return out.drop("_u", "_w")


def anchor_window(edges: DataFrame, width: int | float, seed: object) -> DataFrame:
    """Rows around one weighted anchor edge, by position."""
    n = edges.count()
    reach = int(n * width) if isinstance(width, float) else width
    reach = max(1, min(reach, n))
    anchor = weighted_edges(edges, 1, seed).first()["edge_pos"]
    return edges.filter((F.col("edge_pos") >= anchor - reach) & (F.col("edge_pos") < anchor + reach))


def structural(
    edges: DataFrame, observed: DataFrame, n: int, seed: object, window: int | float | None = None, fallbacks: bool = False
) -> DataFrame:
    """n unseen ordered pairs of the split's own sources and targets, or all there are.

    Time and message are those of the source's first row. With ``fallbacks``, what is
    missing is drawn as ``select_unseen`` does, from the pools' observed pairs. As
    fewer than n pairs are free then, the pools have no more pairs than are observed or asked for.
    """
    rows = edges if window is None else anchor_window(edges, window, seed)
    spark = edges.sparkSession
    s, ns = indexed(rows, "src")
    t, nt = indexed(rows, "tgt")
    if ns * nt == 0 or n == 0:
        raise ValueError("nothing to draw from")

    def ends(cand: DataFrame) -> DataFrame:
        return lookup(lookup(cand, "a", s, "_i", "src", "u"), "b", t, "_i", "tgt", "v")

    new = unseen_pairs(spark, n, (ns, nt), ends, observed, seed, ordered=True)
    if fallbacks:
        new = materialize(new, "unseen")
        if new.count() < n:
            every = numbered_pairs(spark.range(permuted_range(ns * nt)).withColumnRenamed("id", "cand"), (ns, nt), seed)
            every = ends(every).filter(F.col("u") != F.col("v")).select(F.col("cand").alias("slot"), F.col("u").alias("lo"), F.col("v").alias("hi"))
            new = select_unseen(every, observed, n, seed, ("lo", "hi"), fallbacks=True)
            new = global_position(new, ["slot", "lo", "hi"], "_p").select(F.col("_p").alias("slot"), F.col("lo").alias("u"), F.col("hi").alias("v"))
    first = rows.groupBy("src").agg(F.min_by(F.struct("t", "msg"), "edge_pos").alias("f"))
    return new.select("slot", F.col("u").alias("src"), F.col("v").alias("tgt")).join(first, "src").select(
        "slot", "src", "tgt", "f.t", "f.msg"
    )


def time_lattice(deltas: DataFrame, first: int, last: int) -> tuple[int, int, int]:
    """Start, step and count of the plausible times in [first, last].

    They are the multiples of the granularity; if there are none, ``first`` alone.
    """
    unit = deltas.agg(F.max("granularity").alias("g")).first()["g"] or 1
    low, high = -(-first // unit), last // unit
    return (low * unit, unit, high - low + 1) if low <= high else (first, unit, 1)


def _stratum(index: Column, parts: Column, size: Column) -> Column:
    """Where part ``index`` of ``parts`` integer parts of [0, size) begins, without an overflow."""
    over = index * F.pmod(size, parts)
    return index * F.call_function("div", size, parts) + F.call_function("div", over, parts)


def _in_strata(index: Column, parts: Column, size: Column, seed: object, *keys: Column | str) -> Column:
    """A number drawn from the part ``index`` (from 0); parts share no number if there are at most ``size``."""
    low = _stratum(index, parts, size)
    return low + pick(_stratum(index + 1, parts, size) - low, seed, *keys)


def past_taken(draws: DataFrame, taken: DataFrame) -> DataFrame:
    """Turn ``rank``, a place among a pair's free cells, into the cell ``i`` itself.

    ``taken`` (src, tgt, i) lists cells once. The k-th taken cell (from 0) has i - k free
    ones before it, so a draw moves on by the taken cells for which that is at most its rank:
    one running count over both, and no join of a pair's draws with its cells.
    """
    key = ["src", "tgt"]
    rest = [c for c in draws.columns if c not in (*key, "rank")]
    near = taken.join(draws.select(*key).distinct(), key, "left_semi")
    near = group_position(near, key, ["i"], "_k").select(*key, (F.col("i") - F.col("_k") + 1).alias("_at"), F.col("i").alias("_tie"))
    marks = near.select("*", F.lit(0).alias("_draw"), F.lit(None).cast(draws.select(F.struct(*rest)).schema[0].dataType).alias("_r"))
    both = marks.unionByName(
        draws.select(*key, F.col("rank").alias("_at"), F.col("slot").alias("_tie"), F.lit(1).alias("_draw"), F.struct(*rest).alias("_r"))
    )
    counted = running(both, key, ["_at", "_draw", "_tie"], {"_n": F.lit(1).cast("bigint") - F.col("_draw")})
    return counted.filter("_draw = 1").select(*key, (F.col("_at") + F.col("_n")).alias("i"), "_r.*")


def temporal(
    edges: DataFrame,
    observed_t: DataFrame,
    deltas: DataFrame,
    n: int,
    first: int,
    last: int,
    seed: object,
    fallbacks: bool = False,
) -> DataFrame:
    """n existing pairs at plausible times at which they were not seen, or all there are.

    Each slot draws an edge, rare pairs more often, and a pair's slots draw different free
    cells of its times, numbered past those it was seen at. Slots of a pair without enough free
    cells draw from all pairs' remaining cells (with the message of the pair's first
    row; their numbers start at n). ``fallbacks`` adds times the pairs were seen at to the full number.
    """
    spark, key = edges.sparkSession, ["src", "tgt"]
    start, unit, cells = time_lattice(deltas, first, last)
    picked = materialize(weighted_edges(edges, n, seed).select("slot", *key, "msg"), "picked")
    firsts = edges.groupBy(*key).agg(F.min_by("msg", "edge_pos").alias("msg"))
    ahead = F.col("t") - F.lit(start)
    seen = observed_t.filter((ahead >= 0) & (F.pmod(ahead, F.lit(unit)) == 0) & (ahead <= F.lit(unit * (cells - 1))))
    seen = seen.select(*key, F.expr(f"(t - {start}) div {unit}").alias("i")).distinct().join(firsts, key, "left_semi")
    seen = materialize(seen, "taken")
    room = F.lit(cells).cast("bigint") - F.coalesce("_seen", F.lit(0))
    asked = picked.groupBy(*key).agg(F.count("*").alias("_asked"))
    pairs = firsts.join(seen.groupBy(*key).agg(F.count("*").alias("_seen")), key, "left").join(asked, key, "left")
    pairs = pairs.select(*key, "msg", room.alias("_free"), F.least(F.coalesce("_asked", F.lit(0)), room).alias("_take"))
    pairs = materialize(pairs, "pairs")

    placed = group_position(picked, key, ["slot"], "_k").join(pairs.drop("msg"), key).filter("_k <= _take")
    rank = _in_strata(F.col("_k") - 1, F.col("_take"), F.col("_free"), seed, F.lit("time"), *key, "_k")
    made = materialize(past_taken(placed.select("slot", *key, "msg", rank.alias("rank")), seen), "made")

    left = pairs.filter("_free > _take").select(*key, "msg", (F.col("_free") - F.col("_take")).alias("_free"))
    missing = n - made.count()
    total = (left.agg(F.sum("_free").alias("s")).first()["s"] or 0) if missing else 0
    if total:
        count = min(missing, total)
        ordered = running(global_position(left, key, "_p"), [], ["_p"], {"_end": F.col("_free")})
        ordered = materialize(ordered.withColumn("_at", F.col("_end") - F.col("_free")), "cells")
        at = _in_strata(F.col("id"), F.lit(count), F.lit(total), seed, F.lit("rest"), "id")
        draws = materialize(spark.range(count).select("id", at.alias("_g")), "draws")
        both = ordered.select("_at", F.lit(0).alias("_draw"), F.lit(None).cast("bigint").alias("id")).unionByName(
            draws.select(F.col("_g").alias("_at"), F.lit(1).alias("_draw"), "id")
        )
        both = running(both, [], ["_at", "_draw", "id"], {"_p": F.lit(1).cast("bigint") - F.col("_draw")})
        owner = both.filter("_draw = 1").select("id", F.col("_at").alias("_g"), (F.col("_p") - 1).alias("_p"))
        more = owner.join(ordered, "_p").select(
            (F.col("id") + n).alias("slot"), *key, "msg", (F.col("_g") - F.col("_at")).alias("rank")
        )
        taken = seen.unionByName(made.select(*key, "i"))
        made = materialize(made.unionByName(past_taken(more, taken)), "made")
        missing -= count
    if missing and fallbacks:
        spare = seen.join(firsts, key).select(*key, "i", "msg")
        if missing == n:
            again = smallest(spare, n, u01(seed, F.lit("seen"), *key, "i"), [*key, "i"])
            again = global_position(again, [*key, "i"], "slot")
        else:
            spare = spare if not spare.isEmpty() else made.select(*spare.columns)
            spare = global_position(spare, [*key, "i"], "_i")
            again = spark.range(missing).select((F.col("id") + 2 * n).alias("slot"), pick(spare.count(), seed, F.lit("seen"), "id").alias("_i"))
            again = again.join(spare, "_i").drop("_i")
        made = made.unionByName(again.select(*made.columns))
    return made.select("slot", *key, (F.lit(start) + F.col("i") * F.lit(unit)).alias("t"), "msg")


def dissimilar_messages(
    rows: DataFrame, pool: DataFrame, seed: object, sample: int = 25, metric: str = "cosine"
) -> DataFrame:
    """Replace each message by the most dissimilar of a random sample.

    Every row draws ``sample`` positions of the pool, so the join grows with
    the rows, not with the pool.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"metric '{metric}' is not supported")
    table = global_position(pool.select("edge_pos", F.col("msg").alias("other")), ["edge_pos"], "_i")
    n = table.count()
    draws = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(sample))))
    draws = draws.withColumn("_i", pick(n, seed, F.lit("ctx"), "slot", "_k"))
    measure = ar.cosine_distance if metric == "cosine" else ar.l2_distance
    joined = draws.join(table.select("_i", "other"), "_i")
    # rounded, so that equal distances tie and the first draw wins
    far = F.max_by("other", F.struct(F.round(measure("msg", "other"), 9), -F.col("_k")))
    best = joined.groupBy("slot").agg(far.alias("_m"))
    return rows.join(best, "slot").withColumn("msg", F.col("_m")).drop("_m")


def contextual(edges: DataFrame, n: int, seed: object, sample: int = 25, metric: str = "cosine") -> DataFrame:
    """n drawn edges with their message replaced by a dissimilar one."""
    rows = weighted_edges(edges, n, seed).select("slot", "src", "tgt", "t", "msg")
    return dissimilar_messages(rows, edges, seed, sample, metric)


def generate(
    edges: DataFrame,
    kind: str,
    ratio: float,
    split: str,
    seed: object = 0,
    window: int | float | None = None,
    metric: str = "cosine",
    fallbacks: bool = False,
) -> DataFrame:
    """Structural, temporal and contextual anomalies or their mixes.

    ``combination`` splits the target evenly over all six types. Where fewer unseen
    pairs (or pairs and times) exist than are asked for, all of them are returned; ``fallbacks`` adds
    observed ones to the full number.
    """
    kind = TYPE_ALIASES.get(kind, kind)
    if kind not in (*ROW_TYPES, "combination"):
        raise ValueError(f"unknown anomaly type '{kind}'")
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be in [0, 1]")
    rows = materialize(edges.filter(F.col("split") == split), "split_rows")
    span = rows.agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).first()
    n = int(span["n"] * ratio)
    if n == 0:
        raise ValueError("the target is zero")
    kinds = ROW_TYPES if kind == "combination" else (kind,)
    if any("temporal" in k for k in kinds):
        train = edges.filter(F.col("split") == "train")
        deltas = materialize(time_deltas(train), "deltas")
        seen = materialize(edges.select("src", "tgt", "t").distinct(), "seen")
    if any("structural" in k for k in kinds):
        pairs = materialize(observed_pairs(edges, ordered=True), "pairs")
    out = None
    for j, k in enumerate(kinds):
        m = n // len(kinds) + (1 if j < n % len(kinds) else 0)
        if m == 0:
            continue
        salt = f"{seed}-{k}"
        if "structural" in k:
            made = materialize(structural(rows, pairs, m, salt, window, fallbacks), "made")
            if "temporal" in k:
                made = plausible_times(made, deltas, span["a"], span["b"], f"{salt}-t")
                made = made.withColumn("t", F.col("new_t")).drop("new_t")
        elif "temporal" in k:
            made = temporal(rows, seen, deltas, m, span["a"], span["b"], salt, fallbacks)
        else:
            made = contextual(rows, m, salt, metric=metric)
        if k != "contextual" and k.endswith("contextual"):
            made = materialize(made, "made")
            made = dissimilar_messages(made, rows, salt, metric=metric)
        made = made.select("src", "tgt", "t", "msg", F.lit(1).alias("label"), F.lit(split).alias("split"), F.lit(k).alias("kind"))
        out = made if out is None else out.unionByName(made)
    return out


def select_unseen(
    cand: DataFrame, observed: DataFrame, n: int, seed: object, keys: Sequence[str] = ("src", "tgt"), fallbacks: bool = False
) -> DataFrame:
    """n of the candidates (key ``slot``) whose ``keys`` were not observed, drawn by a hash.

    If there are fewer, all of them; with ``fallbacks`` the rest is drawn, with
    repeats, from the observed candidates, or from the unseen ones if none is
    observed, and if all are observed n candidates are drawn without repeats.
    """
    seen = observed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    marked = cand.join(seen, list(keys), "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    marked = materialize(marked, "candidates")
    size = marked.agg(F.count_if(~F.col("_seen")).alias("new"), F.count("*").alias("all")).first()
    new = marked.filter(~F.col("_seen"))
    draw = u01(seed, F.lit("pick"), "slot")
    if size["new"] >= n:
        return smallest(new, n, draw, ["slot"]).drop("_seen")
    if not fallbacks:
        return new.drop("_seen")
    if size["new"] == 0:
        return smallest(marked, n, draw, ["slot"]).drop("_seen")
    spare = marked.filter("_seen") if size["all"] > size["new"] else new
    count = size["all"] - size["new"] or size["new"]
    placed = global_position(spare, ["slot"], "_i")
    extra = cand.sparkSession.range(n - size["new"]).select(pick(count, seed, F.lit("fallback"), "id").alias("_i"))
    return new.unionByName(extra.join(placed, "_i").drop("_i")).drop("_seen")


def inject_rows(
    edges: DataFrame,
    kind: str,
    ratios: Mapping[str, float],
    seed: object = 0,
    window: int | float | None = None,
    metric: str = "cosine",
    fallbacks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Row-wise anomalies in several splits: all edges in order, and a report.

    Edges (src, tgt, t, edge_pos, split, msg) that already hold anomalies are
    refused. The result is ordered by time and source, normal edges first, then by
    target and kind; ``edge_pos`` is the new position. The report has one row per
    split with the requested and the generated number; see ``generate`` for ``fallbacks``.
    """
    if "label" in edges.columns and not edges.filter(F.col("label") == 1).isEmpty():
        raise ValueError("the edges already hold anomalies")
    spark, columns = edges.sparkSession, ["src", "tgt", "t", "msg", "split"]
    counts = {r["split"]: r["count"] for r in edges.groupBy("split").count().collect()}
    out = edges.select(*columns, F.lit(0).alias("label"), F.lit(None).cast("string").alias("kind"), F.col("edge_pos").alias("_old"))
    rows = []
    for split, ratio in ratios.items():
        if not 0.0 <= ratio <= 1.0:
            raise ValueError(f"the ratio of '{split}' must be in [0, 1]")
        requested = int(counts.get(split, 0) * ratio)
        if requested == 0:
            rows.append((split, float(ratio), 0, 0))
            continue
        made = materialize(generate(edges, kind, ratio, split, f"{seed}-{split}", window, metric, fallbacks), "generated")
        rows.append((split, float(ratio), requested, made.count()))
        out = out.unionByName(made.select(*columns, "label", "kind").withColumn("_old", F.lit(None).cast("bigint")))
    ordered = global_position(out, ["t", "src", "label", "_old", "tgt", "kind"], "edge_pos").drop("_old")
    return ordered, spark.createDataFrame(rows, "split string, ratio double, requested bigint, generated bigint")


def nearby_targets(edges: DataFrame, n: int, width: int, seed: object) -> DataFrame:
    """n drawn edges whose target is taken from a row up to ``width`` away.

    Of the targets around an edge that its source was never seen with, one is
    drawn. An edge without such a target is passed over and another drawn in its
    place; if two rounds on end find no further edge, there are none, an error.
    """
    rows = global_position(edges.select("src", "tgt", "t", "edge_pos"), ["edge_pos"], "_i")
    seen = edges.select("src", F.col("tgt").alias("new_tgt")).distinct()
    steps = F.explode(F.array([F.lit(s) for s in range(-width, width + 1) if s])).alias("_s")
    draws, before, idle = 2 * n, -1, 0
    while True:
        drawn = weighted_edges(edges, draws, seed).select("slot", "edge_pos")
        drawn = drawn.join(rows.select("edge_pos", "_i", "src", "t"), "edge_pos")
        cand = drawn.select("*", steps).withColumn("_j", F.col("_i") + F.col("_s"))
        cand = cand.join(rows.select(F.col("_i").alias("_j"), F.col("tgt").alias("new_tgt")), "_j")
        cand = cand.filter("src <> new_tgt").join(seen, ["src", "new_tgt"], "left_anti")
        best = F.min_by("new_tgt", F.struct(u01(seed, F.lit("step"), "slot", "_j"), "_j"))
        made = cand.groupBy("slot", "src", "t").agg(best.alias("tgt"))
        made = global_position(made, ["slot"], "_p")
        found = made.count()
        if found >= n:
            return made.filter(F.col("_p") < n).drop("slot").withColumnRenamed("_p", "slot")
        idle = idle + 1 if found == before else 0
        if idle == 2:
            raise ValueError(f"only {found} of {n} edges have an unseen target nearby")
        before, draws = found, draws * 4


# --- test sets without times ---------------------------------------------


def anomaly_count(n_test: int, share: float) -> int:
    """Anomalies that make up ``share`` of the test set once added."""
    return max(0, int(n_test * share / (1.0 - share + 1e-10)))


def labelled_test_set(edges: DataFrame, train: float, share: float, seed: object = 0) -> DataFrame:
    """Test rows plus unseen pairs of train nodes, labelled and shuffled.

    ``edges`` has a gap-free ``edge_pos``; the first part is train.  ``place``
    is the shuffled position.
    """
    if not 0.0 <= train <= 1.0 or not 0.0 <= share <= 1.0:
        raise ValueError("shares must be in [0, 1]")
    n = edges.count()
    cut = int(n * train)
    pool, size = indexed(
        edges.filter(F.col("edge_pos") < cut).select(F.explode(F.array("src", "tgt")).alias("v")), "v"
    )
    normal = edges.filter(F.col("edge_pos") >= cut).select("src", "tgt", F.lit(0).alias("label"))

    def ends(cand: DataFrame) -> DataFrame:
        return lookup(lookup(cand, "a", pool, "_i", "v", "u"), "b", pool, "_i", "v", "v")

    m = anomaly_count(n - cut, share)
    new = unseen_pairs(edges.sparkSession, m, (size, size), ends, observed_pairs(edges), seed)
    new = new.select(F.col("u").alias("src"), F.col("v").alias("tgt"), F.lit(1).alias("label"))
    both = normal.unionByName(new)
    shuffled = both.withColumn("_u", u01(seed, F.lit("place"), "src", "tgt", "label"))
    return shuffled


def uniform_unseen(edges: DataFrame, num_nodes: int, n: int, seed: object = 0) -> DataFrame:
    """n unseen pairs of any nodes, with time and message of random rows."""

    def ends(cand: DataFrame) -> DataFrame:
        return cand.select("cand", F.col("a").alias("u"), F.col("b").alias("v"))

    new = unseen_pairs(edges.sparkSession, n, (num_nodes, num_nodes), ends, observed_pairs(edges), seed)
    total = edges.count()
    take = [c for c in ("t", "msg") if c in edges.columns]
    rows = edges.select(F.col("edge_pos").alias("_r"), *take)
    return (
        new.select("slot", F.col("u").alias("src"), F.col("v").alias("tgt"))
        .withColumn("_r", pick(total, seed, F.lit("row"), "slot"))
        .join(rows, "_r")
        .drop("_r")
    )


def between_communities(edges: DataFrame, communities: DataFrame, n: int, seed: object = 0) -> DataFrame:
    """n unseen pairs whose ends are in different communities."""
    pool = materialize(global_position(communities, ["node_id"], "_i"), "communities")
    size = pool.count()
    lookup_side = maybe_broadcast(pool)

    def ends(cand: DataFrame) -> DataFrame:
        out = cand
        for at, end, c in (("a", "u", "_cu"), ("b", "v", "_cv")):
            side = lookup_side.select(F.col("_i").alias(at), F.col("node_id").alias(end), F.col("cluster").alias(c))
            out = out.join(side, at).drop(at)
        return out.filter(F.col("_cu") != F.col("_cv")).drop("_cu", "_cv")

    new = unseen_pairs(edges.sparkSession, n, (size, size), ends, observed_pairs(edges), seed)
    return new.select("slot", F.col("u").alias("src"), F.col("v").alias("tgt"))


def scatter_into(test: DataFrame, new: DataFrame, seed: object = 0) -> DataFrame:
    """Put new pairs at random places among the test rows, order kept.

    A new edge takes a random slot of the combined sequence; ``place`` is the
    final position.
    """
    n, m = test.count(), new.count()
    spots = test.sparkSession.range(n + m).withColumn("_u", u01(seed, F.lit("spot"), "id"))
    chosen = smallest(spots.select("id", "_u"), m, F.col("_u"), ["id"]).select("id")
    taken = global_position(chosen, ["id"], "slot")
    free = global_position(
        spots.select("id").join(chosen, "id", "left_anti"), ["id"], "_i"
    )
    rows = global_position(test.select("src", "tgt", "edge_pos"), ["edge_pos"], "_i")
    normal = rows.join(free, "_i").select(F.col("id").alias("place"), "src", "tgt", F.lit(0).alias("label"))
    odd = new.select("slot", "src", "tgt").join(taken, "slot").select(
        F.col("id").alias("place"), "src", "tgt", F.lit(1).alias("label")
    )
    return normal.unionByName(odd)


def report_rows(report: Mapping[str, Any], splits: Sequence[str] = ("train", "val", "test")) -> list[tuple]:
    """The injection report as rows (split, ratio, requested, generated)."""
    return [
        (s, float(r["ratio"]), int(r["requested"]), int(r["generated"]))
        for s in splits
        if (r := report["splits"].get(s))
    ]
