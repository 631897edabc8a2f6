"""Near-duplicate documents by b-bit MinHash and a multi-index Hamming join.

Every distinct shingle set gets a signature of 64 symbols of 8 bits; two sets
of similarity J differ in about 64 * (1 - J) symbols. The signatures are cut
into nine chunks. If two signatures differ in at most ``RADIUS`` = 26 symbols,
then by the pigeonhole principle some chunk differs in at most two, so that
listing, for each chunk, all ways to leave two symbols out gives both documents
a key in common: no pair within the radius is lost. For a similarity of exactly
0.8 the radius lies four standard deviations above the mean distance.

Documents that share a key form a run; documents with equal shingle sets are one
class from the start. A run is sorted into one task with its signatures. There its
smallest document is compared with all others; then those outside the run's largest
component with every member, whatever other runs of the task have linked being
known. Only links that join components are returned, never all pairs. A run of more
than ``RUN`` members is compared in parts first, other ones for each key; where it is
not one component then, the pairs of its parts that hold two components follow.
So every pair within the radius ends in one neighbourhood.

Links are confirmed on the full shingle sets, read from the texts: first between
a neighbourhood's smallest document and its others; then, where that leaves more
than one component, in blocks of bounded size that return a spanning set of
their links. Blocks within one component are skipped, as nothing can be added.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.llm.components import components
from tgraph.llm.textnum import mix, shingles, slices
from tgraph.session import materialize, maybe_broadcast

SYMBOLS = 64
CHUNKS = 9
ERRORS = 2  # symbols left out of each chunk
RADIUS = CHUNKS * (ERRORS + 1) - 1
RUN = 2048  # members of a run that are compared in one task
ROWS = 1 << 16  # rows of runs that a task holds at once
OTHERS = 256  # members compared with their whole run at once
MEMBERS = 512  # documents of a block that is compared as a whole
COLUMNS = 4096  # shingles counted at once in a block
BLOCK = 4096  # signatures whose keys a task holds at once

SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, " + ", ".join(f"s{i} bigint" for i in range(SYMBOLS // 8))
WORDS = [f"s{i}" for i in range(SYMBOLS // 8)]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a, b = rng.integers(0, 1 << 32, (2, SYMBOLS), dtype=np.uint64).astype(np.uint32)
    return a | np.uint32(1), b


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 64) symbols: the low byte of the least permuted hash. Zeros for empty sets."""
    out = np.zeros((len(counts), SYMBOLS), np.uint8)
    full = np.flatnonzero(counts)
    if len(full):
        start = (np.cumsum(counts) - counts)[full]
        h = (values >> np.uint64(32)).astype(np.uint32)
        a, b = _permutations()
        for k in range(SYMBOLS):
            out[full, k] = np.minimum.reduceat(h * a[k] + b[k], start) & np.uint32(255)
    return out


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, texts in slices(batch.column(1)):
                values, n = shingles(texts, k)
                end = np.cumsum(n)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(s))))) for s in (0x51, 0xA7)]
                digest = [(x[end] - x[end - n]).view(np.int64) for x in sums]
                words = signatures(values, n).view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n), *map(pa.array, digest), *(pa.array(words[:, i]) for i in range(words.shape[1]))],
                    ["doc_id", "n_shingles", "d1", "d2", *WORDS],
                )

    return run


def sign(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its set's size, a 128-bit digest of the set, and the signature as eight longs."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_sign(k), SIGNED)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """(texts, keys): a hash for each chunk and each way to leave two of its symbols out."""
    cuts = np.linspace(0, SYMBOLS, CHUNKS + 1).astype(int)
    out, label = [], 0
    wide = symbols.astype(np.uint64)
    for lo, hi in zip(cuts, cuts[1:]):
        for left_out in combinations(range(lo, hi), ERRORS):
            value = np.full(len(symbols), label, np.uint64)
            for c in range(lo, hi):
                if c not in left_out:
                    value = value * np.uint64(257) + wide[:, c] + np.uint64(1)
            out.append(mix(value ^ np.uint64(label << 48)))
            label += 1
    return np.stack(out, 1)


def _runs_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each block of signatures: one row (key, hub, hub) per key, and
    (key, hub, member) for what the block holds besides, so that a key of very
    many documents sends one row a block to its group."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            words = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(1, part.num_columns)], 1)
            keys = chunk_keys(np.ascontiguousarray(words).view(np.uint8).reshape(len(ids), SYMBOLS))
            doc = np.repeat(ids, keys.shape[1])
            keys = keys.ravel()
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            hub = doc[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hub), pa.array(doc)], ["key", "hub", "id"])


def _runs_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, id): (key, hub, id) for all but a run's first hub."""
    key_before = hub_before = None
    for batch in batches:
        key, hub, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        own = hub == doc
        k, h = key[own], hub[own]
        if len(k):
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            lead = h[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
            if k[0] == key_before:
                lead[k == k[0]] = hub_before
                first[0] = False
            key_before, hub_before = k[-1], lead[-1]
            hub = hub.copy()
            hub[own] = lead
            own[own] = first
        yield pa.RecordBatch.from_arrays([pa.array(x[~own]) for x in (key, hub, doc)], ["key", "hub", "id"])


def runs(classes: DataFrame) -> DataFrame:
    """Rows (key, hub, id): classes other than its hub that share a key with it."""
    rows = classes.select("doc_id", *WORDS).mapInArrow(_runs_in_task, "key bigint, hub bigint, id bigint")
    # hubs meet by key; the other rows are only passed on, spread by their id
    rows = rows.repartition(F.when(F.col("hub") == F.col("id"), F.col("key")).otherwise(F.col("id")))
    return rows.sortWithinPartitions("key", "id").mapInArrow(_runs_of_keys, "key bigint, hub bigint, id bigint")


# one bit is left of each byte that is not zero
FOLDS = ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101))


def distance(a: str, b: str) -> Column:
    """Number of different symbols of two signatures of eight longs each."""
    total = F.lit(0)
    for w in WORDS:
        x = F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))
        for shift, mask in FOLDS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total + F.bit_count(x)
    return total


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``distance``, of arrays whose last axis holds the eight words."""
    total = np.uint8(0)
    for i in range(len(WORDS)):
        z = x[..., i] ^ y[..., i]
        for shift, mask in FOLDS:
            z = (z | (z >> np.uint64(shift))) & np.uint64(mask)
        total = total + np.bitwise_count(z)
    return total


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def _join_runs(rows: pa.Table, similarity: int) -> tuple[list[int], list[int]]:
    """Links that join what pairs within the radius join, of whole runs in order."""
    key, part, ids, own, n, *words = (c.to_numpy() for c in rows.columns)
    words = np.stack(words, 1).view(np.uint64)
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
    size = np.diff(start, append=len(key))
    parent, a, b = {}, [], []

    def roots(x: np.ndarray) -> np.ndarray:
        each, at = np.unique(x, return_inverse=True)
        return np.array([_root(parent, v) for v in each.tolist()])[at]

    def near(x, y) -> np.ndarray:
        # sets whose sizes differ too much cannot reach the similarity
        fits = 100 * np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])
        return fits & (apart(words[x], words[y]) <= RADIUS)

    def link(x: np.ndarray, y: np.ndarray) -> None:
        _, one = np.unique(np.stack((own[x], own[y]), 1), axis=0, return_index=True)
        for i, j in zip(x[one].tolist(), y[one].tolist()):
            u, v = _root(parent, int(own[i])), _root(parent, int(own[j]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                a.append(int(ids[i]))
                b.append(int(ids[j]))

    lead = np.repeat(start, size)
    other = np.flatnonzero(own != own[lead])
    other = other[near(lead[other], other)]
    link(lead[other], other)
    now = roots(own)
    mixed = (np.minimum.reduceat(now, start) != np.maximum.reduceat(now, start)) & (size > 2)
    for lo, hi in zip(start[mixed].tolist(), (start + size)[mixed].tolist()):
        run, now = np.arange(lo, hi), roots(own[lo:hi])
        each, at, many = np.unique(now, return_inverse=True, return_counts=True)
        others = np.flatnonzero(at != many.argmax())
        for c in range(0, len(others), OTHERS):
            x = others[c : c + OTHERS]
            i, j = np.nonzero((now[x][:, None] != now) & near(run[x][:, None], run[None, :]))
            if len(i):
                link(run[x[i]], run[j])
    return a, b


def _compare(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS:
                continue
            table = pa.Table.from_batches(held)
            key, part = (table.column(i).to_numpy() for i in range(2))
            # the last run may go on in the next batch
            cut = int(np.flatnonzero((key != key[-1]) | (part != part[-1])).max(initial=-1)) + 1
            if cut:
                yield links(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield links(pa.Table.from_batches(held))

    def links(table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _join_runs(table, similarity)], ["a", "b"])

    return run


def compare(members: DataFrame, sig: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) within the radius that join the components of each part of a run.

    ``members`` has key, part, id and the component that is known of the id.
    """
    rows = members.join(sig, members.id == sig.doc_id).select("key", "part", "id", "component", "n_shingles", *WORDS)
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "id")
    return rows.mapInArrow(_compare(similarity), "a bigint, b bigint")


def _confirm(k: int, similarity: int):
    def words(text: str | None) -> frozenset:
        w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, frozenset()
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            linked = np.zeros(batch.num_rows, bool)
            ids = a.to_pylist()
            for i in range(batch.num_rows):
                if ids[i] != last:
                    last, own = ids[i], words(ta[i].as_py())
                other = words(tb[i].as_py())
                both = len(own & other)
                linked[i] = both > 0 and 100 * both >= similarity * (len(own) + len(other) - both)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(keep)

    return run


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity (percent)."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(k, similarity), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, k: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per document.

    Two documents are linked if 100 times the size of the intersection of their
    sets of distinct ``k``-word shingles is at least ``similarity`` times that of
    the union. Words end at ASCII white space; A-Z are lower-cased. A text of
    fewer words is one shingle; one without words, or null, is linked with nothing.
    ``component_id`` is the smallest doc_id reachable; ``kept`` marks it. Rows that
    repeat a doc_id are returned each and share its component; if their texts
    differ, they link what either links. A row whose doc_id is null is returned
    with a null component, kept, and linked with nothing. Other columns are
    ignored; an empty table gives an empty result. Texts of any length are read
    whole. ``similarity`` below 80 would need a larger radius and is refused.
    """
    if similarity < 80:
        raise ValueError("the signature's radius is set for a similarity of 80 percent or more")
    signed = materialize(sign(docs, k, id_col, text_col), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), *(F.min(w).alias(w) for w in WORDS)),
        "classes",
    )
    same = full.select("d1", "d2", "n_shingles", F.col("doc_id").alias("b")).join(
        classes.select("d1", "d2", "n_shingles", F.col("doc_id").alias("a")), ["d1", "d2", "n_shingles"]
    )
    # a doc_id may head two classes if it is repeated; either signature finds its links
    sig = classes.select("doc_id", "n_shingles", *WORDS)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    hood = materialize(_neighbourhoods(classes, sig, similarity), "hoods")
    pairs = hood.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    links = materialize(confirm(pairs, texts, k, similarity), "links")
    label = materialize(components(links), "components")
    rest = materialize(_block_pairs(hood, label), "blocks")
    links = links.union(confirm_blocks(rest, texts, k, similarity))
    all_links = links.union(same.where("a <> b").select("a", "b"))
    final = components(all_links)
    out = signed.join(final, signed.doc_id == final.id, "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _neighbourhoods(classes: DataFrame, sig: DataFrame, similarity: int) -> DataFrame:
    """(id, component): components of the pairs within the radius; ids without one are left out."""
    star = materialize(runs(classes), "keys")
    # a run's first hub is its smallest document
    sizes = materialize(star.groupBy("key").agg(F.min("hub").alias("id"), (F.count("*") + 1).alias("n")), "runs")
    members = star.select("key", "id").union(sizes.select("key", "id"))
    large = materialize(sizes.where(F.col("n") > RUN).select("key", F.ceil(F.col("n") * 2 / RUN).alias("parts")), "large")
    if large.isEmpty():
        whole = members.select("key", F.lit(0).cast("bigint").alias("part"), "id", F.col("id").alias("component"))
        return materialize(components(compare(whole, sig, similarity)), "hoods")
    large = maybe_broadcast(large)
    # documents that are apart in one run meet in another, as the parts differ by key
    part = F.coalesce(F.pmod(F.xxhash64("key", "id"), F.col("parts")), F.lit(0))
    first = members.join(large, "key", "left").select("key", part.alias("part"), "id", F.col("id").alias("component"))
    close = materialize(compare(first, sig, similarity), "close")
    label = materialize(components(close), "hoods")
    held = members.join(large.select("key"), "key", "left_semi").select("id", F.col("key").alias("component"))
    rest = _block_pairs(held, label).select(F.col("hood").alias("key"), F.col("pair").alias("part"), "id")
    rest = rest.join(label, "id", "left").select("key", "part", "id", F.coalesce("component", "id").alias("component"))
    return materialize(components(close.union(compare(rest, sig, similarity))), "hoods")


def _block_pairs(hood: DataFrame, label: DataFrame) -> DataFrame:
    """(hood, lo, hi, id): the members of each pair of blocks of a neighbourhood
    that is not one component yet. Members are put in blocks by component, so that
    a large component fills blocks of its own, and pairs of those are left out."""
    at = hood.join(label.select("id", F.col("component").alias("own")), "id", "left")
    at = at.select(F.col("component").alias("hood"), F.coalesce("own", "id").alias("own"), "id")
    mixed = at.groupBy("hood").agg(F.count("*").alias("n"), F.min("own").alias("x"), F.max("own").alias("y"))
    # of two members, the neighbourhood's smallest has met the other already
    at = materialize(at.join(mixed.where("x <> y and n > 2").select("hood"), "hood"), "members")
    # blocks: each component is cut into parts by a hash, and small parts are packed together by another
    sizes = at.groupBy("hood", "own").agg(F.count("*").alias("n"))
    total = sizes.where(F.col("n") < MEMBERS // 2).groupBy("hood").agg(F.sum("n").alias("small"))
    cut = at.join(sizes, ["hood", "own"]).join(total, "hood", "left")
    big = F.col("n") >= MEMBERS // 2
    parts = lambda n: F.ceil(F.coalesce(n, F.lit(1)) * 2 / MEMBERS)
    cut = cut.select(
        "hood", "id", F.when(big, F.col("own")).alias("own"),
        F.when(big, F.pmod(F.xxhash64("id"), parts(F.col("n")))).otherwise(F.pmod(F.xxhash64("own"), parts(F.col("small")))).alias("part"),
    )
    cut = materialize(cut, "cut")
    blocks = cut.select("hood", "own", "part").distinct()
    x, y = blocks.alias("x"), blocks.alias("y")
    first = lambda t: F.struct(F.coalesce(f"{t}.own", F.lit(-(1 << 62))), F.col(f"{t}.part"))
    on = (F.col("x.hood") == F.col("y.hood")) & (first("x") <= first("y"))
    # two blocks of one large component have nothing to add
    pairs = x.join(y, on & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    pairs = pairs.select(
        F.col("x.hood").alias("hood"), F.array(F.struct("x.own", "x.part"), F.struct("y.own", "y.part")).alias("both")
    )
    pairs = pairs.withColumn("pair", F.xxhash64("hood", "both")).select("hood", "pair", F.explode(F.array_distinct("both")).alias("at"))
    same = (cut.hood == pairs.hood) & cut.own.eqNullSafe(F.col("at.own")) & (cut.part == F.col("at.part"))
    return cut.join(pairs, same).select(cut.hood, "pair", "id")


def _spanning(values: np.ndarray, counts: np.ndarray, similarity: int) -> np.ndarray:
    """For each set, the first set of its component under links within the block."""
    n = len(counts)
    doc = np.repeat(np.arange(n), counts)
    distinct, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    doc, column = doc[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        has = np.zeros((n, COLUMNS), np.float32)
        has[doc[a:b], column[a:b] - lo] = 1
        both += has @ has.T
    union = counts[:, None] + counts[None, :] - both
    linked = (100 * both.astype(np.int64) >= similarity * union.astype(np.int64)) & (both > 0)
    first = np.arange(n)
    while True:
        least = np.where(linked, first[None, :], n).min(1)
        least = np.minimum(first, least)
        least = least[least]
        if (least == first).all():
            return first
        first = least


def _confirm_block(k: int, similarity: int):
    def solve(rows: list[tuple[int, str]]) -> tuple[list[int], list[int]]:
        values, n = shingles([t for _, t in rows], k)
        first = _spanning(values, n, similarity)
        out = [(rows[f][0], rows[i][0]) for i, f in enumerate(first) if f != i]
        return [a for a, _ in out], [b for _, b in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for key, i, text in zip(keys, batch.column(2).to_pylist(), batch.column(3)):
                if key != at and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in solve(rows)], ["a", "b"])
                    rows = []
                at = key
                rows.append((i, text.as_py()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in solve(rows)], ["a", "b"])

    return run


def confirm_blocks(blocks: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """Links (a, b) that span the components within each pair of blocks."""
    rows = blocks.join(texts, blocks.id == texts.doc_id).select("hood", "pair", "id", "text")
    rows = rows.repartition("hood", "pair").sortWithinPartitions("hood", "pair", "id")
    return rows.mapInArrow(_confirm_block(k, similarity), "a bigint, b bigint")
