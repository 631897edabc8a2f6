"""Near-duplicate embeddings by a pivot-permutation index, verified by cosine.

Every vector is described by its ``NEAREST`` nearest reference points (pivots).
Inverted lists hold the vectors by their combinations of ``SHARED`` of these, so
two vectors meet in a list if and only if they share that many pivots. A pair is
verified, by its cosine in double precision, only in the list of the least pivots
it shares. Pivots come from a bounded hash sample of the distinct vectors, and no
two of them are close, so that one large group of copies does not hold them all.
Their number grows with the cube root of the vectors', which keeps lists of the
same mean length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.llm.components import components
from tgraph.session import materialize

COSINE = 0.95
NEAREST = 6
SHARED = 3
FEWEST, MOST = 32, 1024  # pivots
SAMPLE = 4  # vectors drawn for each pivot wanted, on average
APART = 0.9  # cosine of two pivots at most
BLOCK = 1024  # vectors of a list that are compared at once; longer lists are cut


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame, total: int) -> dict[int, np.ndarray]:
    """For each vector length, unit vectors that are not close to each other."""
    wanted = min(MOST, max(FEWEST, ceil((8 * total) ** (1 / 3))))
    share = SAMPLE * wanted / max(total, 1)
    drawn = classes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))
    out: dict[int, list[np.ndarray]] = {}
    for r in drawn.select("vector", "id").orderBy(F.xxhash64("id", F.lit(6)), "id").limit(2 * SAMPLE * wanted).collect():
        v = unit(np.array(r.vector, float)[None])[0]
        own = out.setdefault(len(v), [])
        if len(own) < wanted and (not own or (np.array(own) @ v).max() < APART):
            own.append(v)
    return {dim: np.array(own) for dim, own in out.items()}


def _describe(pivots: dict[int, np.ndarray], single: bool):
    """Rows (at, id, n, pivots, vector): a vector in each list it belongs to.

    Vectors of a length with too few pivots are all in one list, by their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, vectors = (batch.column(i).to_pylist() for i in range(3))
            lengths = np.array([len(v) for v in vectors])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                own = unit(np.array([vectors[i] for i in at], float))
                refs = pivots.get(int(dim))
                if refs is None or len(refs) < NEAREST:
                    keys, near = np.full((len(at), 1), -int(dim), np.int64), [[]] * len(at)
                else:
                    # ties go to the lower pivot number
                    near = np.sort(np.argsort(-(own @ refs.T), axis=1, kind="stable")[:, :NEAREST], 1)
                    keys = np.zeros((len(at), 0), np.int64)
                    for some in combinations(range(NEAREST), SHARED):
                        key = np.full(len(at), int(dim), np.int64)
                        for j in some:
                            key = key * (MOST + 1) + near[:, j]
                        keys = np.concatenate((keys, key[:, None]), 1)
                    near = near.tolist()
                times = keys.shape[1]
                rep = np.repeat(np.arange(len(at)), times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel()), pa.array([ids[at[i]] for i in rep], pa.int64()), pa.array([counts[at[i]] for i in rep], pa.int64()),
                        pa.array([near[i] for i in rep], pa.list_(pa.int32())), pa.array([vectors[at[i]] for i in rep], pa.list_(pa.float32() if single else pa.float64())),
                    ],
                    ["at", "id", "n", "pivots", "vector"],
                )

    return run


def _links_of_block(at: int, lo: int, hi: int, rows: list[tuple], cosine: float) -> tuple[list, list, list]:
    """(a, b, n): n vectors linked to a, where b is null; or a link of the block's spanning set."""
    part = np.array([r[0] for r in rows])
    ids, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    z = unit(np.array([r[4] for r in rows], float))
    linked = z @ z.T >= cosine
    if at > 0:
        # shared pivots up to the list's last one: more than the list's own, and the pair belongs elsewhere
        last = at % (MOST + 1)
        has = np.zeros((len(rows), last + 1), np.float32)
        for i, r in enumerate(rows):
            has[i, [p for p in r[3] if p <= last]] = 1
        linked &= has @ has.T == SHARED
    np.fill_diagonal(linked, False)
    if lo != hi:
        linked &= part[:, None] != part[None, :]
    touched = np.flatnonzero(linked.any(1))
    a, b, times = ids[touched].tolist(), [None] * len(touched), (linked @ n)[touched].tolist()
    first = np.arange(len(rows))
    while True:
        least = np.minimum(first, np.where(linked, first[None, :], len(rows)).min(1))
        least = least[least]
        if (least == first).all():
            break
        first = least
    moved = np.flatnonzero(first != np.arange(len(rows)))
    return a + ids[first[moved]].tolist(), b + ids[moved].tolist(), times + [0] * len(moved)


def _links(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                columns = _links_of_block(*key, rows, cosine)
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "n"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for at, lo, hi, *row in zip(*columns):
                if (at, lo, hi) != key:
                    yield from done()
                    key, rows = (at, lo, hi), []
                rows.append(row)
        yield from done()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per vector.

    Links are pairs that share ``SHARED`` of their ``NEAREST`` pivots and whose
    cosine is at least ``cosine``. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing, nor do vectors of unequal length.
    Equal vectors are one class and linked. ``n_links`` counts the rows linked,
    rows that repeat a vec_id included; ``component_id`` is the smallest vec_id
    reachable. A row whose vec_id is null has no links, a null component, and is
    kept. Other columns are ignored; an empty table gives an empty result.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    good = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull()
    own = own.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(1)))
    classes = own.where("good").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = materialize(classes, "classes")
    listed = classes.select("id", "n", "vector").mapInArrow(
        _describe(choose_pivots(classes, classes.count()), kind == "array<float>"),
        f"at bigint, id bigint, n bigint, pivots array<int>, vector {kind}",
    )
    listed = materialize(listed, "lists")
    sizes = listed.groupBy("at").agg(F.count("*").alias("size")).where("size > 1")
    parts = sizes.select("at", F.ceil(F.col("size") / (BLOCK // 2)).cast("int").alias("parts"))
    cut = listed.join(materialize(parts, "parts"), "at").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a list of several parts is compared part by part, each pair of parts in a task of its own
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cut = cut.select("at", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "n", "pivots", "vector")
    cut = cut.repartition("at", "lo", "hi").sortWithinPartitions("at", "lo", "hi", "id")
    links = materialize(cut.mapInArrow(_links(cosine), "a bigint, b bigint, n bigint"), "links")
    counted = links.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    member = own.where("good").select("id", "h1", "h2").join(classes.select(F.col("id").alias("rep"), F.col("n").alias("copies"), "h1", "h2"), ["h1", "h2"])
    member = materialize(member.select("id", "rep", "copies", "h1", "h2"), "members")
    edges = links.where("b is not null").select("a", "b").union(member.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found = components(edges)
    by_class = classes.select("h1", "h2", F.col("id").alias("rep"), F.col("n").alias("copies")).join(counted, F.col("rep") == F.col("a"), "left")
    by_class = by_class.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = own.select("id", "good", "h1", "h2").join(by_class.withColumn("good", F.lit(True)), ["good", "h1", "h2"], "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = out.join(found, out.vec_id == found.id, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
