"""Neighbours strictly earlier in time, by rank instead of a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tgraph.functions.arrays import left_pad
from tgraph.functions.random import pick
from tgraph.operators.ordering import group_position, largest_group, running
from tgraph.session import GROUP_ROWS, materialize

# Ranks of a node's history in one row.
BLOCK = 32


def incidence(edges: DataFrame, eid: str = "edge_pos") -> DataFrame:
    """Every edge from both of its ends: node, nbr, t, eid."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("tgt").alias("nbr")),
        F.struct(F.col("tgt").alias("node"), F.col("src").alias("nbr")),
    )
    return edges.select(F.explode(ends).alias("e"), "t", F.col(eid).alias("eid")).select(
        "e.node", "e.nbr", "t", "eid"
    )


def ranked_incidence(edges: DataFrame, eid: str = "edge_pos") -> DataFrame:
    """Incidence rows numbered per node in time order; hub nodes included."""
    return materialize(
        group_position(incidence(edges, eid), ["node"], ["t", "eid", "nbr"], "rn"), "incidence"
    )


def sorted_adjacency(edges: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """Time-sorted adjacency of the given splits (train; train+val; all)."""
    return ranked_incidence(edges.filter(F.col("split").isin(*splits)))


def history_size(inc: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (qid, node, t) with ``c``, the number of earlier rows of the node.

    Counts per (node, time) are summed along time together with the query
    times, so no row is compared with all earlier ones.
    """
    steps = inc.groupBy("node", "t").agg(F.count("*").alias("_n"))
    asked = queries.select("node", "t").distinct().withColumn("_n", F.lit(0).cast("bigint"))
    marks = steps.unionByName(asked).groupBy("node", "t").agg(F.sum("_n").alias("_n"))
    marks = running(marks, ["node"], ["t"], {"_upto": F.col("_n")})
    before = marks.select("node", "t", (F.col("_upto") - F.col("_n")).alias("c"))
    return queries.join(before, ["node", "t"])


def history_stats(inc: DataFrame, queries: DataFrame) -> DataFrame:
    """Count, sum of neighbour ids and latest time of each query's history.

    Running totals per node over (time, kind), queries placed before rows of
    the same time, so earlier interactions are never listed per query.
    """
    steps = inc.groupBy("node", "t").agg(
        F.lit(1).alias("_kind"), F.count("*").alias("_n"), F.sum("nbr").alias("_s"), F.max("t").alias("_m")
    )
    zero = F.lit(0).cast("bigint")
    asked = queries.select("node", "t").distinct().select(
        "node", "t", F.lit(0).alias("_kind"), zero.alias("_n"), zero.alias("_s"),
        F.lit(None).cast(inc.schema["t"].dataType).alias("_m"),
    )
    marks = materialize(steps.select(*asked.columns).unionByName(asked), "marks")
    sums = running(marks, ["node"], ["t", "_kind"], {"n": F.col("_n"), "nbrs": F.col("_s")})
    tops = running(sums, ["node"], ["t", "_kind"], {"last_t": F.col("_m")}, how="max")
    known = tops.filter("_kind = 0").select("node", "t", "n", "nbrs", "last_t")
    return queries.join(known, ["node", "t"]).select("qid", "node", "n", "nbrs", "last_t")


def edge_queries(edges: DataFrame) -> DataFrame:
    """One query per edge end: qid is edge_pos * 2 (+1 for the target)."""
    ends = F.array(
        F.struct((F.col("edge_pos") * 2).alias("qid"), F.col("src").alias("node")),
        F.struct((F.col("edge_pos") * 2 + 1).alias("qid"), F.col("tgt").alias("node")),
    )
    return edges.select(F.explode(ends).alias("q"), "t").select("q.qid", "q.node", "t")


def earlier_neighbors(inc: DataFrame, queries: DataFrame) -> DataFrame:
    """All earlier interactions of each query's node."""
    sized = history_size(inc, queries).filter("c > 0")
    wanted = sized.select("qid", "node", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))).alias("rn"))
    hits = inc.select("node", "rn", "nbr", F.col("t").alias("nbr_t"), "eid")
    return wanted.join(hits, ["node", "rn"]).drop("rn")


def recent_neighbors(inc: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k most recent earlier interactions; ``slot`` 0 is the latest."""
    sized = history_size(inc, queries).filter("c > 0")
    first = F.greatest(F.lit(1).cast("bigint"), F.col("c") - F.lit(k - 1))
    wanted = sized.select("qid", "node", "c", F.explode(F.sequence(first, F.col("c"))).alias("rn"))
    hits = inc.select("node", "rn", "nbr", F.col("t").alias("nbr_t"), "eid")
    out = wanted.join(hits, ["node", "rn"])
    return out.select("qid", "node", (F.col("c") - F.col("rn")).alias("slot"), "nbr", "nbr_t", "eid")


def sampled_neighbors(inc: DataFrame, queries: DataFrame, k: int, seed: object) -> DataFrame:
    """k uniform draws with replacement from the earlier interactions."""
    sized = history_size(inc, queries).filter("c > 0")
    wanted = sized.select("qid", "node", "c", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"))
    wanted = wanted.withColumn("rn", pick(F.col("c"), seed, "qid", "draw") + 1)
    hits = inc.select("node", "rn", "nbr", F.col("t").alias("nbr_t"), "eid")
    return wanted.join(hits, ["node", "rn"]).select("qid", "node", "draw", "nbr", "nbr_t", "eid")


def padded(neighbors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row per query with arrays of length k, oldest first, zeros in front."""
    items = F.array_sort(F.collect_list(F.struct("nbr_t", "eid", "nbr")))
    packed = neighbors.groupBy("qid").agg(items.alias("_l"))
    out = queries.join(packed, "qid", "left")
    empty = F.coalesce("_l", F.array().cast(packed.schema["_l"].dataType))
    zero = F.lit(0).cast("bigint")

    def column(field: str, name: str) -> Column:
        return left_pad(F.transform(empty, lambda x: x[field].cast("bigint")), k, zero).alias(name)

    return out.select(
        "qid", "node", "t",
        column("nbr", "neighbors"), column("eid", "edge_ids"), column("nbr_t", "edge_times"),
    )


def packed_history(inc: DataFrame, over: int) -> DataFrame:
    """Ranked incidence in blocks of BLOCK ranks: (node, blk, t, items), items in rank order.

    ``t`` is the time of the block's first row. The last ``over`` rows of the
    block before are copied in front, so that at least as many rows lie before any
    time within the block.
    """
    place = F.col("rn") - 1
    blk = F.floor(place / F.lit(BLOCK)).cast("bigint")
    homes = F.when(F.pmod(place, F.lit(BLOCK)) >= BLOCK - over, F.array(blk, blk + 1)).otherwise(F.array(blk))
    item = F.struct("rn", "nbr", F.col("t").alias("nbr_t"), "eid")
    rows = inc.select("node", F.explode(homes).alias("blk"), item.alias("item"))
    packed = rows.groupBy("node", "blk").agg(F.array_sort(F.collect_list("item")).alias("items"))
    first = F.get(F.filter("items", lambda x: x["rn"] > F.col("blk") * BLOCK), F.lit(0))
    # a block of copies only has no row of its own
    return packed.filter(first.isNotNull()).select("node", "blk", first["nbr_t"].alias("t"), "items")


def recent_excluding(blocks: DataFrame, queries: DataFrame, k: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The k most recent earlier interactions whose other end is not to be skipped.

    ``blocks`` is a ``packed_history``; queries are (root, node, t, skip), where
    ``skip`` is an array. Rows (root, node, found) hold arrays, the latest first.
    The block of a query's time usually has all it needs, so that a query
    travels once; for the others older blocks are read, four times as many each round,
    until every query has k rows or no history left.
    """
    asked = queries.filter(F.col("node").isNotNull() & F.col("t").isNotNull())
    ask = F.struct("root", "skip").alias("_q")
    block = F.struct("blk", "items").alias("_b")
    # a block that begins at a query's time is not earlier
    marks = blocks.select("node", "t", F.lit(1).alias("_kind"), F.lit(None).cast(asked.select(ask).schema["_q"].dataType).alias("_q"), block)
    marks = marks.unionByName(asked.select("node", "t", F.lit(0).alias("_kind"), ask), allowMissingColumns=True)
    if largest_group(marks, ["node"]) <= group_rows:
        w = Window.partitionBy("node").orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        near = marks.withColumn("_b", F.last("_b", ignorenulls=True).over(w)).filter("_kind = 0")
    else:
        marks = marks.select("node", "t", "_kind", "_q", F.col("_b.blk").alias("_v"))
        near = running(marks, ["node"], ["t", "_kind"], {"blk": F.col("_v")}, group_rows, how="max")
        near = near.filter("_kind = 0").join(blocks.select("node", "blk", block), ["node", "blk"])
    wanted = _latest("_b.items", "_q.skip", F.col("t"), k)
    state = near.filter("_b IS NOT NULL").select(
        F.col("_q.root").alias("root"), "node", F.col("_q.skip").alias("skip"), wanted.alias("found"), F.col("_b.items")[0]["rn"].alias("below")
    )
    # the skipped nodes are kept only where the search goes on
    more = (F.size("found") < k) & (F.col("below") > 1)
    state = state.select("root", "node", "found", F.when(more, F.col("skip")).alias("skip"), F.when(more, F.col("below")).alias("below"))
    state = materialize(state, "recent")
    found, many = state.select("root", "node", "found"), 1
    rest = state.filter("below IS NOT NULL").select("root", "node", "skip", "below", (F.lit(k) - F.size("found")).alias("need"))
    while not rest.isEmpty():
        rest = materialize(rest.withColumn("_id", F.monotonically_increasing_id()), "state")
        top = F.floor((F.col("below") - 2) / F.lit(BLOCK)).cast("bigint")
        low = F.greatest(F.lit(0).cast("bigint"), top - F.lit(many - 1))
        spread = rest.withColumn("_low", low).withColumn("blk", F.explode(F.sequence(low, top)))
        read = spread.join(blocks.select("node", "blk", "items"), ["node", "blk"])
        own = F.filter("items", lambda x: (x["rn"] > F.col("blk") * BLOCK) & (x["rn"] < F.col("below")))
        read = read.withColumn("items", own).withColumn("part", _latest("items", "skip", None, F.col("need")))
        got = read.groupBy("_id").agg(
            F.first("root").alias("root"), F.first("node").alias("node"), F.first("skip").alias("skip"), F.first("need").alias("need"),
            F.first("_low").alias("_low"), F.reverse(F.array_sort(F.flatten(F.collect_list("part")))).alias("found"),
        )
        state = materialize(got.withColumn("found", F.slice("found", F.lit(1), F.col("need"))), "recent")
        found = found.unionByName(state.select("root", "node", "found"))
        rest = state.filter("size(found) < need AND _low > 0")
        rest = rest.select("root", "node", "skip", (F.col("_low") * BLOCK + 1).alias("below"), (F.col("need") - F.size("found")).alias("need"))
        many *= 4
    return found


def _latest(items: str, skip: str, t: Column | None, k: int | Column) -> Column:
    """The last k items before ``t`` that are not skipped, the latest first."""

    def wanted(x: Column) -> Column:
        keep = ~F.coalesce(F.array_contains(F.col(skip), x["nbr"]), F.lit(False))
        return keep if t is None else keep & (x["nbr_t"].isNull() | (x["nbr_t"] < t))

    return F.slice(F.reverse(F.filter(items, wanted)), F.lit(1), F.lit(k) if isinstance(k, int) else k)


def layered_neighbors(edges: DataFrame, roots: DataFrame, k: int, layers: int) -> DataFrame:
    """Neighbours of neighbours, all earlier than the root's own time.

    ``roots`` is (root, node, t).  Each layer takes the k most recent earlier
    interactions of the layer before, leaving out the nodes two layers up.
    """
    blocks = materialize(packed_history(ranked_incidence(edges), min(BLOCK, 4 * k)), "history")
    none = F.array().cast("array<bigint>")
    frontier = roots.select("root", "node", "t", none.alias("skip"))
    out = None
    for layer in range(1, layers + 1):
        got = recent_excluding(blocks, frontier, k)
        rows = got.select("root", F.lit(layer).alias("layer"), "node", F.explode("found").alias("f"))
        rows = rows.select("root", "layer", "node", "f.nbr", "f.nbr_t", "f.eid")
        out = rows if out is None else out.unionByName(rows)
        if layer < layers:
            skip, times = F.collect_set("node").alias("skip"), F.collect_list("t").alias("times")
            if layer == 1:
                above = roots.groupBy("root").agg(skip, times)
            else:
                above = frontier.groupBy("root").agg(skip).join(roots.groupBy("root").agg(times), "root")
            reached = got.select("root", F.transform("found", lambda x: x["nbr"]).alias("nbrs"))
            reached = reached.groupBy("root").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nodes"))
            # packed, a row a root
            packed = materialize(reached.join(above, "root"), "frontier")
            frontier = packed.select("root", F.explode("nodes").alias("node"), "times", "skip")
            frontier = frontier.select("root", "node", F.explode("times").alias("t"), "skip")
    return out


def node_messages(edges: DataFrame, msg: str, size: int) -> DataFrame:
    """Mean message vector and latest time per end node."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node"), "t", msg)
    means = [F.avg(F.get(msg, F.lit(i))) for i in range(size)]
    return ends.groupBy("node").agg(
        F.array(*means).alias("message"), F.max("t").alias("last_t"), F.count("*").alias("n")
    )
