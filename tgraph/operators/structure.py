"""Cleaning and reshaping of edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.functions.random import pick, u01
from tgraph.operators.ordering import global_position
from tgraph.session import maybe_broadcast


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _train(split: str) -> Column:
    return F.col(split) == "train"


def drop_self_loops(
    edges: DataFrame, src: str = "src", tgt: str = "tgt", train_only: bool = False
) -> DataFrame:
    keep = F.col(src) != F.col(tgt)
    return edges.filter(~_train("split") | keep if train_only else keep)


def canonical(
    edges: DataFrame, src: str = "src", tgt: str = "tgt", train_only: bool = False
) -> DataFrame:
    """Smaller id first, in all rows or in train rows only."""
    lo, hi = F.least(src, tgt), F.greatest(src, tgt)
    if train_only:
        lo = F.when(_train("split"), lo).otherwise(F.col(src))
        hi = F.when(_train("split"), hi).otherwise(F.col(tgt))
    return edges.withColumns({src: lo, tgt: hi})


def reversed_edges(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    return edges.withColumns({src: F.col(tgt), tgt: F.col(src)})


def with_reversed(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Every edge in both directions, features repeated."""
    both = F.array(
        F.struct(F.col(src).alias("a"), F.col(tgt).alias("b")),
        F.struct(F.col(tgt).alias("a"), F.col(src).alias("b")),
    )
    out = edges.withColumn("_e", F.explode(both))
    return out.withColumns({src: F.col("_e.a"), tgt: F.col("_e.b")}).drop("_e")


def dedup(
    edges: DataFrame,
    keys: Sequence[str] = ("src", "tgt", "t"),
    order: Sequence[str] = ("edge_id",),
    train_only: bool = False,
) -> DataFrame:
    """Keep the first row of each key in ``order``.

    An aggregate with a map-side part, so any number of copies of one key
    shrinks to one row per task before the shuffle.
    """
    keys = list(keys)
    if train_only:
        kept = dedup(edges.filter(_train("split")), keys, order)
        return kept.unionByName(edges.filter(~_train("split")))
    rest = [c for c in edges.columns if c not in keys]
    if not rest:
        return edges.select(*keys).distinct()
    first = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    out = edges.groupBy(*keys).agg(first.alias("_f"))
    return out.select(
        *[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in edges.columns]
    )


def undirected(edges: DataFrame, order: Sequence[str] = ("edge_id",)) -> DataFrame:
    """Append reversed edges, put the smaller id first, drop repeats."""
    return dedup(canonical(with_reversed(edges)), order=order)


def undirected_pairs(edges: DataFrame, pos: str = "edge_pos") -> DataFrame:
    """Each unordered pair once per direction, with its first row position."""
    pairs = (
        canonical(edges.select("src", "tgt", pos))
        .groupBy("src", "tgt")
        .agg(F.min(pos).alias(pos))
    )
    return with_reversed(pairs)


def first_occurrence(edges: DataFrame, value: str, pos: str = "edge_pos") -> DataFrame:
    """Position of the first row of each value."""
    return edges.groupBy(value).agg(F.min(pos).alias("first_pos"))


def nodes_of(edges: DataFrame, name: str = "node_id") -> DataFrame:
    return edges.select(F.explode(F.array("src", "tgt")).alias(name)).distinct()


def node_mapping(edges: DataFrame) -> DataFrame:
    """Distinct endpoints in order with new ids 0..N-1."""
    return global_position(nodes_of(edges, "original_id"), ["original_id"], "new_id")


def reindex_nodes(
    edges: DataFrame, nodes: DataFrame | None = None, node_id: str = "node_id"
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Give endpoints (long or string) dense ids; returns edges, nodes, mapping.

    The mapping is broadcast only if its row count was checked; otherwise the
    lookups are shuffle joins against a side with unique keys, whose hot
    partitions are split at run time.
    """
    mapping = node_mapping(edges)
    lookup = maybe_broadcast(mapping)

    def encode(df: DataFrame, col: str) -> DataFrame:
        m = lookup.select(F.col("original_id").alias(col), F.col("new_id").alias("_new"))
        out = df.join(m, col)
        return out.select(
            *[F.col("_new").alias(c) if c == col else F.col(c) for c in df.columns]
        )

    coded = encode(encode(edges, "src"), "tgt")
    return coded, None if nodes is None else encode(nodes, node_id), mapping


def shift_ids(edges: DataFrame, by: int = -1) -> DataFrame:
    return edges.withColumns({"src": F.col("src") + by, "tgt": F.col("tgt") + by})


def bipartite_offset(edges: DataFrame, base: str = "max") -> DataFrame:
    """Move target ids behind the source ids.

    ``max`` shifts by the largest source id + 1, ``count`` by the number of
    distinct sources, ``one_based`` shifts sources by 1 and targets after them.
    """
    if base == "count":
        off = edges.select("src").distinct().count()
        return edges.withColumn("tgt", F.col("tgt") + F.lit(off))
    top = edges.agg(F.max("src").alias("m")).first()["m"]
    if base == "max":
        return edges.withColumn("tgt", F.col("tgt") + F.lit(top + 1))
    if base == "one_based":
        return edges.withColumns(
            {"src": F.col("src") + 1, "tgt": F.col("tgt") + F.lit(top + 2)}
        )
    raise ValueError(f"unknown base '{base}'")


def node_types(edges: DataFrame) -> DataFrame:
    """Type 0 for ids seen as source, type 1 for ids seen only as target."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node_id"), F.lit(0).alias("k")),
                F.struct(F.col("tgt").alias("node_id"), F.lit(1).alias("k")),
            )
        ).alias("e")
    )
    return ends.groupBy("e.node_id").agg(F.min("e.k").alias("node_type"))


def endpoint_labels(edges: DataFrame, node_labels: DataFrame) -> DataFrame:
    """Edge label 1 if either endpoint is labelled 1."""
    marked = maybe_broadcast(
        node_labels.filter(F.col("label") == 1).select("node_id").distinct()
    )
    out = edges
    for end in ("src", "tgt"):
        m = marked.select(F.col("node_id").alias(end), F.lit(1).alias(f"_{end}"))
        out = out.join(m, end, "left")
    flag = (F.coalesce("_src", F.lit(0)) + F.coalesce("_tgt", F.lit(0)) > 0).cast("int")
    return out.select(*edges.columns, flag.alias("label"))


def binarize(label: str = "label") -> Column:
    return (F.col(label) != 0).cast("int")


def flip(col: str) -> Column:
    """Turn the convention round: 1 - x."""
    return F.lit(1) - F.col(col)


def recode_labels(label: str = "label") -> Column:
    """-1 (spam) to 1, 1 (genuine) to 0; other values as they are."""
    return F.when(F.col(label) == -1, 1).when(F.col(label) == 1, 0).otherwise(F.col(label))


def mask_labels(edges: DataFrame, fraction: float, seed: object, key: str) -> DataFrame:
    """Set the label of a fraction of train rows to -1."""
    hide = _train("split") & (u01(seed, key) < F.lit(float(fraction)))
    return edges.withColumn("label", F.when(hide, F.lit(-1)).otherwise(F.col("label")))


def flip_label_noise(edges: DataFrame, fraction: float, seed: object, key: str) -> DataFrame:
    """Flip exactly ``int(n * fraction)`` train labels: those drawn lowest.

    The cut-off is the k-th lowest draw, found by position, so nothing is
    sorted by one task.
    """
    rows = edges.filter(_train("split"))
    k = int(rows.count() * fraction)
    if k == 0:
        return edges
    draw = u01(seed, key)
    placed = global_position(rows.select(draw.alias("_u"), key), ["_u", key], "_p")
    last = placed.filter(F.col("_p") == k - 1).first()
    chosen = F.struct(draw.alias("_u"), F.col(key)) <= F.struct(
        F.lit(last["_u"]).alias("_u"), F.lit(last[key]).alias(key)
    )
    return edges.withColumn(
        "label",
        F.when(_train("split") & chosen, F.lit(1) - F.col("label")).otherwise(F.col("label")),
    )


def upsample_positives(
    edges: DataFrame, factor: int, seed: object, key: str = "edge_pos"
) -> DataFrame:
    """Add ``factor`` draws with replacement per positive train row.

    Draw i of a positive takes the positive at a random position; positions
    are joined, not collected.  ``copy`` is 0 for original rows.
    """
    positives = global_position(
        edges.filter(_train("split") & (F.col("label") == 1)), [key], "_i"
    )
    n = positives.count()
    if n == 0 or factor == 0:
        return edges.withColumn("copy", F.lit(0).cast("bigint"))
    draws = edges.sparkSession.range(1, n * factor + 1).select(
        F.col("id").alias("copy"), pick(n, seed, F.col("id")).alias("_i")
    )
    extra = draws.join(positives, "_i").drop("_i")
    return edges.withColumn("copy", F.lit(0).cast("bigint")).unionByName(extra)


def drop_rows(edges: DataFrame, rate: float, seed: object, key: str) -> DataFrame:
    """Drop a random fraction of rows; the rest keeps its position."""
    return edges.filter(u01(seed, key) >= F.lit(float(rate)))


def add_self_loops(edges: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Append one self-loop per node with zero features."""
    loops = nodes_of(edges, "src").select(
        "src",
        F.col("src").alias("tgt"),
        *[F.lit(0).cast(edges.schema[f].dataType).alias(f) for f in features],
    )
    return edges.select("src", "tgt", *features).unionByName(loops)


def fill_empty(
    centres: DataFrame, neighbours: DataFrame, key: str, nbr: str, node: str
) -> DataFrame:
    """Left join that gives centres without neighbours themselves as one."""
    out = centres.join(neighbours, key, "left")
    return out.withColumn(nbr, F.coalesce(F.col(nbr), F.col(node)))


def edge_frequency(edges: DataFrame) -> DataFrame:
    """Number of rows of each ordered pair, joined back to its rows."""
    counts = edges.groupBy("src", "tgt").agg(F.count("*").alias("freq"))
    return edges.join(counts, ["src", "tgt"])


def inverse_frequency(edges: DataFrame, over: str = "rows", power: float = -1.5) -> DataFrame:
    """Weight ``count^power`` of each pair over the sum, as ``p`` per row.

    ``over='rows'`` normalises by the sum over rows, ``'unique'`` by the sum
    over distinct pairs.
    """
    counts = edges.groupBy("src", "tgt").agg(F.count("*").alias("_n"))
    weight = F.pow(F.col("_n").cast("double"), F.lit(power))
    share = weight * F.col("_n") if over == "rows" else weight
    total = counts.agg(F.sum(share).alias("s")).first()["s"] or 0.0
    p = weight / F.lit(total + 1e-10)
    return edges.join(counts.select("src", "tgt", p.alias("p")), ["src", "tgt"])
