"""Draws from pools, weighted draws and unseen pairs, all without collecting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tgraph.functions.random import permuted, permuted_range, pick, u01
from tgraph.operators.ordering import global_position, running, shifted
from tgraph.session import BROADCAST_ROWS, materialize, maybe_broadcast

# Targets that a source meets in one row.
PRODUCT_ROWS = 1_000

# Pairs of a product that one task lists.
TASK_PAIRS = 20_000_000


def observed_pairs(edges: DataFrame, ordered: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs as ``lo``, ``hi`` (smaller id first unless ``ordered``)."""
    lo = F.col("src") if ordered else F.least("src", "tgt")
    hi = F.col("tgt") if ordered else F.greatest("src", "tgt")
    return edges.select(lo.alias("lo"), hi.alias("hi"), *extra).distinct()


def indexed(pool: DataFrame, key: str, name: str = "_i") -> tuple[DataFrame, int]:
    """A pool of distinct values with positions, and its size."""
    table = global_position(pool.select(key).distinct(), [key], name)
    return table, table.count()


def lookup(draws: DataFrame, index: str, pool: DataFrame, pool_index: str, value: str, name: str) -> DataFrame:
    """Replace a drawn position by the pool's value at that position."""
    side = pool.select(F.col(pool_index).alias(index), F.col(value).alias(name))
    return draws.join(maybe_broadcast(side), index).drop(index)


def product_sample(
    spark: SparkSession, pools: Sequence[tuple[str, DataFrame, str]], n: int, seed: object
) -> DataFrame:
    """``n`` draws from the product of pools, never building the product.

    ``pools`` lists (output name, table, column).  Each draw picks a position
    in every pool and is joined to its values.
    """
    out = spark.range(n).withColumnRenamed("id", "draw")
    for name, pool, key in pools:
        table, size = indexed(pool, key)
        out = out.withColumn("_d", pick(size, seed, F.lit(name), "draw"))
        out = lookup(out, "_d", table, "_i", key, name)
    return out


def pair_product(src_pool: DataFrame, tgt_pool: DataFrame, limit: int | None = None, without: DataFrame | None = None) -> DataFrame:
    """All pairs of two pools, numbered by ``draw``; refused above a ``limit`` of pairs, if one is given.

    Each source meets the targets in blocks of PRODUCT_ROWS, listed inside the task that writes
    them, so that no pair is shuffled. ``without`` (lo, hi) are unordered pairs to leave out;
    they are joined to the source and the block, not to the pairs.
    """
    s, n = indexed(src_pool, "src")
    t, m = indexed(tgt_pool, "tgt")
    if limit is not None and n * m > limit:
        raise ValueError(f"{n} x {m} pairs exceed the limit of {limit}; sample instead")
    home = F.floor(F.col("_i") / F.lit(PRODUCT_ROWS)).cast("bigint").alias("_b")
    blocks = t.groupBy(home).agg(F.collect_list(F.struct("_i", "tgt")).alias("_t"))
    blocks = F.broadcast(blocks) if m <= BROADCAST_ROWS else blocks
    rows = s.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, m - 1) // PRODUCT_ROWS))))
    listed = F.col("_t")
    if without is not None:
        both = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("tgt")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("tgt")))
        seen = without.select(F.explode(both).alias("p")).select("p.*").join(t.withColumn("_b", home), "tgt")
        seen = seen.groupBy("src", "_b").agg(F.collect_set("tgt").alias("_seen"))
        rows = rows.join(seen, ["src", "_b"], "left")
        seen_one = F.coalesce("_seen", F.array().cast(seen.schema["_seen"].dataType))
        listed = F.filter(listed, lambda x: ~F.coalesce(F.array_contains(seen_one, x["tgt"]), F.lit(False)))
    # few rows now, and many in the same tasks below
    parts = max(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * m // TASK_PAIRS)
    out = rows.repartition(parts).join(blocks, "_b").select("src", "_i", F.explode(listed).alias("p"))
    return out.select((F.col("_i") * F.lit(m) + F.col("p._i")).alias("draw"), "src", F.col("p.tgt").alias("tgt"))


def weighted_pick(
    draws: DataFrame, u: str, items: DataFrame, weight: str, order: Sequence[str]
) -> DataFrame:
    """Join each draw to the item whose share of the total weight covers ``u``.

    The unit interval is cut into as many cells as there are items; an item is
    listed in each cell its share touches, so the range test only runs inside
    a cell.  An item with a large share spans many cells and is spread by them.
    """
    placed = global_position(items, list(order), "_pos")
    table = running(placed, [], ["_pos"], {"_hi": F.col(weight).cast("double")})
    # an item begins exactly where the one before it ends, so that no draw falls between two or on both
    table = materialize(shifted(table, "_pos", {"_before": F.col("_hi")}, -1), "weighted")
    row = table.agg(F.max("_hi").alias("t"), F.count("*").alias("n")).first()
    total, cells = row["t"], max(1, row["n"])
    if not total:
        raise ValueError("weights sum to zero")
    # the largest sum is the total, so the last item with a weight ends at 1, which no draw reaches
    lo, up = (F.coalesce(c, F.lit(0.0)) / F.lit(total) for c in ("_before", "_hi"))

    def cell(x: Column) -> Column:
        return F.least(F.floor(x * F.lit(float(cells))).cast("bigint"), F.lit(cells - 1))

    spread = table.select(*items.columns, lo.alias("_lo"), up.alias("_up")).filter("_lo < _up")
    spread = spread.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_up")))))
    hit = (F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_up"))
    out = draws.withColumn("_cell", cell(F.col(u))).join(spread, "_cell").filter(hit)
    return out.drop("_cell", "_lo", "_up")


def smallest(df: DataFrame, n: int, draw: Column, key: Sequence[str]) -> DataFrame:
    """The n rows with the lowest draw, found by position."""
    placed = global_position(df.withColumn("_u", draw), ["_u", *key], "_p")
    return placed.filter(F.col("_p") < n).drop("_u", "_p")


def numbered_pairs(cand: DataFrame, sizes: tuple[int, int], seed: object) -> DataFrame:
    """Columns cand, a, b: the pair of positions that a permutation gives each number."""
    out = permuted(cand, "cand", sizes[0] * sizes[1], seed, "_code")
    width = F.lit(sizes[1])
    return out.select("cand", F.expr(f"_code div {sizes[1]}").alias("a"), F.pmod("_code", width).alias("b"))


def unseen_pairs(
    spark: SparkSession,
    n: int,
    sizes: tuple[int, int],
    ends: Callable[[DataFrame], DataFrame],
    observed: DataFrame,
    seed: object,
    ordered: bool = False,
) -> DataFrame:
    """The first ``n`` drawn pairs that are new, with their number ``slot``.

    Pairs of positions in two pools of the given ``sizes`` are drawn without repeats,
    by a permutation of all pair numbers; ``ends`` turns them (cand, a, b) into cand, u, v.
    Self-loops, observed pairs and, unless ``ordered``, the second of two turned pairs are dropped.
    More numbers are drawn until enough pairs remain or all numbers are drawn; then
    the result holds every pair there is. That only happens if most pairs are observed
    or asked for, so no more are drawn than those many times over.
    """
    if not n or not sizes[0] * sizes[1]:
        found = ends(spark.range(0).select(F.col("id").alias("cand"), F.col("id").alias("a"), F.col("id").alias("b")))
        return found.select(F.col("cand").alias("slot"), "cand", "u", "v")
    every = permuted_range(sizes[0] * sizes[1])
    count = min(every, 8 * n + 64)
    while True:
        cand = ends(numbered_pairs(spark.range(count).withColumnRenamed("id", "cand"), sizes, seed))
        lo = F.col("u") if ordered else F.least("u", "v")
        hi = F.col("v") if ordered else F.greatest("u", "v")
        fresh = cand.filter(F.col("u") != F.col("v")).withColumns({"lo": lo, "hi": hi})
        fresh = fresh.join(observed.select("lo", "hi"), ["lo", "hi"], "left_anti")
        if not ordered:
            fresh = fresh.groupBy("lo", "hi").agg(F.min_by(F.struct("cand", "u", "v"), "cand").alias("f")).select("f.*")
        kept = global_position(fresh.select("cand", "u", "v"), ["cand"], "slot")
        if count == every or kept.count() >= n:
            return kept.filter(F.col("slot") < n)
        count = min(every, count * 4)


def ranked_non_edges(
    slots: DataFrame,
    num_nodes: int,
    forbidden: DataFrame,
    seed: object,
    on: Sequence[str],
    since: str | None,
    at: str,
    upper: bool,
    anchor: str | None,
    below: str | None,
) -> DataFrame:
    """``non_edges`` by rank: no tries, null ends only where no non-edge exists.

    What may be drawn is numbered: ids from 0 beside an anchor, else the pairs
    lo < hi by hi, lo. A slot draws a rank among the free numbers; the taken
    numbers f_0 < f_1 < ... with f_j - j up to the rank are stepped over. They
    are counted by one running sum over taken numbers and ranks, so a hub's
    slots are not multiplied by its neighbours. Taken numbers are listed once a
    combination of snapshot, anchor and bound that has open slots.
    """
    keys = list(dict.fromkeys([*on, *([at] if since else []), *([anchor] if anchor else []), *([below] if below else [])]))
    rows = slots.withColumn("_all", F.lit(0))
    keys = ["_all", *keys]
    groups = rows.select(*keys).distinct()
    taken = forbidden.select(*on, "lo", "hi", *([F.col(since).alias("_since")] if since else []))
    if anchor:
        one = taken.withColumnsRenamed({"lo": anchor, "hi": "_code"})
        two = taken.withColumnsRenamed({"hi": anchor, "lo": "_code"})
        taken = groups.join(one.unionByName(two), [*on, anchor])
        first = F.col(anchor) + 1 if upper else F.lit(0).cast("bigint")
        total = F.greatest((F.col(below) if below else F.lit(num_nodes)) - first, F.lit(0))
    else:
        taken = taken.filter("lo < hi").withColumn("_code", F.expr("shiftright(hi * (hi - 1), 1) + lo"))
        taken = groups.join(taken, list(on)) if on else taken.crossJoin(maybe_broadcast(groups))
        first, total = F.lit(0).cast("bigint"), F.lit(num_nodes * (num_nodes - 1) // 2)
    if since:
        taken = taken.filter(F.col("_since") <= F.col(at))
    taken = taken.select(*keys, "_code")
    if anchor:
        taken = taken.unionByName(groups.select(*keys, F.col(anchor).alias("_code")))
    taken = taken.select(*keys, (F.col("_code") - first).alias("_code"), total.alias("_total"))
    taken = taken.filter((F.col("_code") >= 0) & (F.col("_code") < F.col("_total"))).select(*keys, "_code").distinct()
    taken = materialize(taken, "taken")
    free = total - F.coalesce("_n", F.lit(0))
    asked = rows.join(taken.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left").withColumn("_free", free)
    asked = asked.filter("_free > 0").withColumn("_rank", pick(F.col("_free"), seed, F.lit("rank"), "slot"))
    one = F.lit(1).cast("bigint")
    steps = running(taken, keys, ["_code"], {"_j": one})
    steps = steps.select(*keys, (F.col("_code") - F.col("_j") + 1).alias("_rank"), F.col("_code").alias("_tie"), one.alias("_taken"))
    ranks = asked.select(*keys, "_rank", F.col("slot").alias("_tie"), (one - 1).alias("_taken"))
    both = materialize(steps.unionByName(ranks), "ranks")
    placed = running(both, keys, ["_rank", F.col("_taken").desc(), "_tie"], {"_past": F.col("_taken")})
    placed = placed.filter("_taken = 0").select(F.col("_tie").alias("slot"), (F.col("_rank") + F.col("_past")).alias("_code"))
    out = rows.join(placed, "slot", "left")
    if anchor:
        out = out.withColumns({"u": F.when(F.col("_code").isNotNull(), F.col(anchor)), "v": F.col("_code") + first})
    else:
        hi = F.floor((1 + F.sqrt(1 + 8 * F.col("_code").cast("double"))) / 2).cast("bigint")
        # the root may be off by one
        out = out.withColumn("_hi", hi).withColumn("_hi", F.expr("_hi - int(shiftright(_hi * (_hi - 1), 1) > _code)"))
        out = out.withColumn("_hi", F.expr("_hi + int(shiftright(_hi * (_hi + 1), 1) <= _code)"))
        out = out.withColumn("_lo", F.col("_code") - F.shiftright(F.expr("_hi * (_hi - 1)"), 1))
        turned = F.lit(False) if upper else u01(seed, F.lit("turn"), "slot") < 0.5
        out = out.withColumns({"u": F.when(turned, F.col("_hi")).otherwise(F.col("_lo")), "v": F.when(turned, F.col("_lo")).otherwise(F.col("_hi"))})
    return materialize(out.select(*slots.columns, "u", "v"), "negatives")


def non_edges(
    slots: DataFrame,
    num_nodes: int,
    forbidden: DataFrame,
    seed: object,
    on: Sequence[str] = (),
    since: str | None = None,
    at: str = "snapshot_id",
    upper: bool = False,
    anchor: str | None = None,
    below: str | None = None,
    tries: int = 8,
    max_tries: int = 120,
) -> DataFrame:
    """One non-edge (u, v) per row of ``slots`` (key ``slot``).

    A try is refused if it is a self-loop, if the pair is in ``forbidden``
    (lo, hi, plus the ``on`` columns), or, with ``since``, if the pair was
    first seen no later than the slot's ``at``.  The first good try wins.
    ``upper`` asks for u < v; ``anchor`` fixes u to a column; ``below`` draws v
    under a per-row bound, for anchored slots.  Open slots get twice as many
    tries each round, up to ``max_tries`` in all; slots still open then draw
    from the listed non-edges, and have null ends only if there are none.
    """
    if below and not anchor:
        raise ValueError("below needs an anchor")
    keep = list(slots.columns)
    remaining, found, start = slots, [], 0
    while start < max_tries:
        stop = min(max_tries, start + tries)
        numbers = F.sequence(F.lit(start), F.lit(stop - 1))
        start, tries = stop, tries * 2
        bound = F.col(below) if below else F.lit(num_nodes)
        u = F.col(anchor) if anchor else pick(num_nodes, seed, F.lit("u"), "slot", "try")
        cand = remaining.withColumn("try", F.explode(numbers)).withColumns(
            {"u": u, "v": pick(bound, seed, F.lit("v"), "slot", "try")}
        )
        cand = cand.filter(F.col("u") < F.col("v") if upper else F.col("u") != F.col("v"))
        cand = cand.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
        keys = ["lo", "hi", *on]
        if since is None:
            good = cand.join(forbidden.select(*keys), keys, "left_anti")
        else:
            seen = forbidden.select(*keys, F.col(since).alias("_since"))
            good = cand.join(seen, keys, "left")
            good = good.filter(F.col("_since").isNull() | (F.col("_since") > F.col(at)))
        best = good.groupBy("slot").agg(F.min_by(F.struct("u", "v"), "try").alias("b"))
        best = materialize(remaining.join(best, "slot").select(*keep, "b.u", "b.v"), "negatives")
        found.append(best)
        remaining = remaining.join(best, "slot", "left_anti")
        if remaining.isEmpty():
            break
        remaining = materialize(remaining, "open")
    else:
        found.append(ranked_non_edges(remaining, num_nodes, forbidden, seed, on, since, at, upper, anchor, below))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
