"""Groups of spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted once. Blocked Bloom filters, one shard per word length,
are made of partial bit sums and broadcast. Each word generates its edits: every
deletion, and every replacement by a larger code point (the other neighbours find
it from their side). An edit's hash comes from the word's own in a few operations,
so no edit is ever spelt out; it probes the shard of its length, and only positives
are shuffled, as (hash of the edit, hash of the word), to the join with the
vocabulary. There the words themselves are compared, which removes false positives
of the filters and of the hashes.

A round of filters holds ``CAPACITY`` words, which bounds what is broadcast; a
larger vocabulary is cut by hash into as many parts as it needs, and every part is
probed in a round of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.llm.textnum import mix, slices
from tgraph.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
LONGEST_SHARD = 64  # words of this length and beyond share a shard
BITS = 16  # of a filter for each word
HASHES = 5  # bits set for a word, all in one 64-bit block
CAPACITY = 1 << 24  # words of a round of filters: 32 MB
CELLS = 1 << 18  # edits handled at once by a task
COUNTED = 1 << 17  # distinct words that a task adds up before it passes them on
PROBED = 50_000  # words whose edits a task probes
ROWS = 1 << 16  # positives passed on at once

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _count(shortest: int, every: int):
    """Counts of each task's words, with the letter deleted that the contract asks for."""
    find = re.compile(f"[{LETTERS}]{{{shortest},}}").findall

    def changed(doc_id: int | None, run: str) -> str:
        if every and doc_id is not None:
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                return run[:at] + run[at + 1 :]
        return run

    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, texts in slices(batch.column(1)):
                for i, text in enumerate(texts):
                    if text is None:
                        continue
                    for word, n in Counter(find(text.translate(_LOWER).decode())).items():
                        word = changed(ids[lo + i], word)
                        if len(word) >= shortest:
                            total[word] += n
                    if len(total) >= COUNTED:
                        yield flush(total)
                        total = Counter()
        yield flush(total)

    return run


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 0
) -> DataFrame:
    """Columns (word, n): words of ``shortest`` code points and ``least`` occurrences or more.

    With ``every`` > 0, a word whose crc32 of ``<id>:<word>`` it divides loses one
    letter in that document, which plants variants; rows without an id are left alone.
    """
    own = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary"))
    counted = own.mapInArrow(_count(shortest, every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of the words, one length after the other, in small matrices."""
    size = np.array([len(w) for w in words], np.int64)
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        step = max(1, CELLS // max(length, 1))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            raw = "".join([words[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(raw, np.uint32).reshape(len(part), length).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, _BASE))))


def _key(value: np.ndarray, length: int) -> np.ndarray:
    return mix(value + np.uint64(length))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        key = np.zeros(len(words), np.uint64)
        for at, code in _by_length(words):
            key[at] = _key((code * _powers(code.shape[1])[:-1]).sum(1, dtype=np.uint64), code.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.view(np.int64))], ["word", "n", "key"])


def _mask(key: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), np.uint64)
    for i in range(HASHES):
        out |= np.uint64(1) << ((key >> np.uint64(6 * i)) & np.uint64(63))
    return out


def _block(key: np.ndarray, blocks: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _shard(length: int) -> int:
    return min(length, LONGEST_SHARD)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key ^ np.uint64(0x51)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _fill(sizes: dict[int, int], part: int, parts: int):
    """A bit mask for each block that a word of the part sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            shard = batch.column(1).to_numpy(zero_copy_only=False)
            own = _part(key, parts) == part
            key, shard = key[own], shard[own]
            blocks = np.zeros(len(key), np.uint64)
            for s in np.unique(shard).tolist():
                blocks[shard == s] = sizes[s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(((key >> np.uint64(32)) * blocks >> np.uint64(32)).astype(np.int64)), pa.array(_mask(key).view(np.int64))],
                ["shard", "block", "mask"],
            )

    return run


def _filters(words: DataFrame, counts: dict[int, int], part: int, parts: int) -> dict[int, np.ndarray]:
    """Bloom filters of one part of the vocabulary, by shard; at most ``CAPACITY`` * ``BITS`` bits or so."""
    sizes = {s: max(1, -(-n * BITS // (64 * parts))) for s, n in counts.items()}
    own = words.select("key", F.least(F.length("word"), F.lit(LONGEST_SHARD)).cast("bigint").alias("shard"))
    masks = own.mapInArrow(_fill(sizes, part, parts), "shard bigint, block bigint, mask bigint")
    table = masks.groupBy("shard", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    shard, block, mask = (table.column(i).to_numpy() for i in range(3))
    out = {}
    for s, size in sizes.items():
        out[s] = np.zeros(size, np.uint64)
        own_rows = shard == s
        out[s][block[own_rows]] = mask[own_rows].view(np.uint64)
    return out


def _probe(shared, alphabet: np.ndarray, part: int, parts: int):
    """(edit, key) for each edit that the filters may hold."""

    def positives(filters: dict, value: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        bloom = filters.get(_shard(length))
        if bloom is None:
            return value[:0], at[:0]
        edit = _key(value, length)
        own = _mask(edit)
        held = (bloom[_block(edit, len(bloom))] & own) == own
        edit, at = edit[held], at[held]
        if parts > 1:
            own = _part(edit, parts) == part
            edit, at = edit[own], at[own]
        return edit, at

    def edits(words: list[str], keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Hash of each edit before its last mixing, its word's key, and its length."""
        for at, code in _by_length(words):
            n, length = code.shape
            if not length:
                continue  # its neighbours delete their letter
            own = keys[at]
            power = _powers(length)
            terms = code * power[:-1]
            before = np.cumsum(terms, 1, dtype=np.uint64)
            total = before[:, -1:].copy()
            # without a letter: what follows moves down by one power
            value = before - terms + (total - before) * _INVERSE
            first = np.ones((n, length), bool)
            first[:, 1:] = code[:, 1:] != code[:, :-1]  # of equal neighbours, either gives the same word
            row, _ = np.nonzero(first)
            yield value[first], own[row], length - 1
            for c in alphabet:
                row, col = np.nonzero(code < c)
                yield total[row, 0] + (c - code[row, col]) * power[col], own[row], length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            held, size = [], 0
            for value, at, length in edits(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
                held.append(positives(filters, value, at, length))
                size += len(held[-1][0])
                if size >= ROWS:
                    yield rows(held)
                    held, size = [], 0
            if size:
                yield rows(held)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        edit, key = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(edit.view(np.int64)), pa.array(key)], ["edit", "key"])

    return run


def _code_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            seen.update(word)
    yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in seen], pa.int64())], ["c"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b), each once, of words one inserted, deleted or replaced code point apart.

    ``words`` has columns (word, n, key) and different words. The alphabet is that
    of the words: 90 code points for the words of ``vocabulary``.
    """
    spark = words.sparkSession
    alphabet = np.array(sorted(r.c for r in words.select("word").mapInArrow(_code_points, "c bigint").distinct().collect()), np.uint64)
    shard = F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("shard")
    counts = {r.shard: r["count"] for r in words.groupBy(shard).count().collect()}
    total = sum(counts.values())
    if not total:
        return spark.createDataFrame([], "a string, b string, n_a bigint, n_b bigint")
    parts, found = -(-total // CAPACITY), None
    spread = words.select("word", "key").repartition(-(-total // PROBED), "key")
    for part in range(parts):
        shared = spark.sparkContext.broadcast(_filters(words, counts, part, parts))
        own = spread.mapInArrow(_probe(shared, alphabet, part, parts), "edit bigint, key bigint")
        if parts > 1:
            own = materialize(own, "positives")
            shared.unpersist()
        found = own if found is None else found.union(own)
    # the exact join; most words of the vocabulary are met by few positives
    b = words.select(F.col("key").alias("edit"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    a = words.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    met = found.join(b, "edit").join(a, "key")
    return met.where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, by doubling the steps."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = state.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        longer = materialize(longer, "roots")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        state = longer.select("word", "root")


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) per row (word, n) of ``words``.

    A word's form is its near word of largest ``n`` (ties: least in code point
    order), if that has at least ``times`` times the word's ``n``; else null. The root is
    where forms lead, the word itself if it has none. Forms grow by ``times`` >= 2 with
    each step, so they end, after at most log(n) steps. Rows that repeat a word
    are added up; null words and counts are left out; an empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its variant")
    own = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    own = materialize(own.mapInArrow(_hash, "word string, n bigint, key bigint"), "words")
    pairs = materialize(near_words(own), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best: Column = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.m") >= F.lit(times) * F.col("n")
    out = own.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"),
    )
    out = materialize(out, "forms")
    roots = _roots(out.where("form is not null"))
    out = out.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 0, times: int = 10
) -> DataFrame:
    """``group_variants`` of the words of whole texts.

    Words are maximal runs of Latin-1 letters (from A to Z, a to z and from U+00C0 to
    U+00FF); only A-Z are lower-cased. Null and empty texts have none; rows that repeat
    a doc_id count each; other columns are ignored, whatever their names.
    """
    return group_variants(vocabulary(docs, id_col, text_col, shortest, least, every), times)

