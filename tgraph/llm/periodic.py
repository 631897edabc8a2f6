"""Periodic runs in word sequences by online dyadic square catching.

Words are appended; every completed block of 2**k words becomes a catcher. The
catcher of a block at ``s`` of length L waits for the block to come again ``q``
words later, 2L-1 <= q <= 4L-2, so that each period belongs to one level. Every
square with period q holds a whole block of its level in its first half, hence
some catcher meets it. An appended word ends one window per level, which is
compared with the at most three catchers that wait for it, by hashes of the
windows (a window's hash is made of those of its halves). A meeting starts a
comparison of the words q apart, to the left and to the right; it advances with
the words that follow, reports a square as soon as 2q words agree, and grows
into a run until a word disagrees. Comparisons are made on the words' numbers,
so hashes only choose where to compare.

Appending takes any number of words at once, which are handled by vector
operations; the runs do not depend on how the words are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.llm.textnum import slices

EXPONENT = 4  # a run holds its period at least this many times
LEAST = 6  # and at least this many words

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _B
    return x ^ (x >> np.uint64(29))


class SquareCatcher:
    """Runs of a growing sequence of word numbers."""

    def __init__(self) -> None:
        self.words = np.empty(1024, np.int64)
        self.n = 0
        self.tails: list[tuple[int, np.ndarray]] = []  # per level: first position, hashes of the windows from there
        self.runs: dict[tuple[int, int], int] = {}  # (start, period): end
        self.open: set[tuple[int, int]] = set()  # those whose last word is the last of all

    def append(self, words: np.ndarray) -> None:
        """Take the next words and advance all comparisons."""
        if not len(words):
            return
        n, total = self.n, self.n + len(words)
        if total > len(self.words):
            self.words = np.concatenate((self.words[:n], np.empty(max(total, 2 * n) - n, np.int64)))
        self.words[n:total] = words
        self.n = total
        self._advance()
        below, level = None, 0
        while (length := 1 << level) <= total:
            if level == len(self.tails):
                self.tails.append((0, np.empty(0, np.uint64)))
            first, tail = self.tails[level]
            new = first + len(tail)  # the first window that was not complete before
            if level == 0:
                made = _spread((self.words[new:total] + 1).astype(np.uint64) * _A)
            else:
                start, half = below
                part = half[new - start :]
                made = _spread(part[: total - length + 1 - new] * _A + part[length // 2 :][: total - length + 1 - new])
            hashes = np.concatenate((tail, made))
            self._meet(length, first, hashes, new)
            below = (first, hashes)
            keep = min(len(hashes), 5 * length)
            self.tails[level] = (first + len(hashes) - keep, hashes[len(hashes) - keep :].copy())
            level += 1
        self._forget()

    def found(self, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, each with its smallest period."""
        best: dict[tuple[int, int], int] = {}
        for (start, q), end in self.runs.items():
            if end - start >= max(least, exponent * q):
                best[start, end] = min(q, best.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in best.items())

    def _advance(self) -> None:
        """Go on with the comparisons that had reached the last word."""
        for key in self.open:
            end = self.runs[key]
            self.runs[key] = end + self._agree(end, key[1])

    def _forget(self) -> None:
        """Drop comparisons that ended before they made a square."""
        self.open = {key for key, end in self.runs.items() if end == self.n}
        self.runs = {key: end for key, end in self.runs.items() if end == self.n or end - key[0] >= 2 * key[1]}

    def _agree(self, at: int, q: int, left: bool = False) -> int:
        """How many words from ``at`` on (or before it) equal those ``q`` before (behind) them."""
        x, done, step = self.words, 0, 16
        while True:
            if left:
                lo = max(at - done - step, 0)
                same = (x[lo : at - done] == x[lo + q : at - done + q])[::-1]
            else:
                lo = at + done
                hi = min(lo + step, self.n)
                same = x[lo:hi] == x[lo - q : hi - q]
            if not len(same):
                return done
            if not same.all():
                return done + int(same.argmin())
            done += len(same)
            step = min(4 * step, 1 << 16)

    def _meet(self, length: int, first: int, hashes: np.ndarray, new: int) -> None:
        """Compare the windows from ``new`` on with the catchers of their level."""
        last = first + len(hashes)
        if last <= new:
            return
        base = -(-first // length)  # the first block whose hash is held
        blocks = hashes[base * length - first :: length]
        starts, periods = [], []
        for back in (1, 2, 3):
            # windows from block ``b`` + back on, against block ``b``
            lo = max(new, (base + back) * length)
            if lo >= last:
                continue
            own = blocks[lo // length - back - base : (last - 1) // length - back - base + 1]
            own = np.repeat(own, length)[lo % length :][: last - lo]
            hit = np.flatnonzero(own == hashes[lo - first :])
            at = hit + lo
            s = (at // length - back) * length
            q = at - s
            fits = (q >= 2 * length - 1) & (q <= 4 * length - 2)
            starts.append(s[fits])
            periods.append(q[fits])
        if not starts:
            return
        s, q = np.concatenate(starts), np.concatenate(periods)
        if len(s):
            fresh = self._fresh(s, q, length)
            s, q = s[fresh], q[fresh]
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        border = np.flatnonzero(np.diff(q)) + 1
        for group, period in zip(np.split(s, border), q[np.concatenate(([0], border))].tolist() if len(q) else []):
            self._compare(group, period, length)

    def _fresh(self, s: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
        """Which meetings are not inside a known run whose period divides theirs."""
        fresh = np.ones(len(s), bool)
        held = [(p, a, end) for (a, p), end in self.runs.items() if end - a >= max(3 * length - 1, 2 * p)]
        if not held:
            return fresh
        period, start, end = np.array(sorted(held)).T
        for p in np.unique(period).tolist():
            own = period == p  # two runs of one period share fewer than p words, so only the last one can hold a meeting
            at = np.searchsorted(start[own], s, "right") - 1
            inside = (at >= 0) & (s + q + length <= end[own][np.maximum(at, 0)])
            fresh &= ~(inside & (q % p == 0))
        return fresh

    def _compare(self, starts: np.ndarray, q: int, length: int) -> None:
        """Stretches of words that equal those ``q`` later, around the given blocks."""
        x = self.words
        if len(starts) < 8 or (starts[-1] - starts[0]) > 64 * length * len(starts):
            covered = -1
            for s in starts.tolist():
                if s >= covered:
                    a = s - self._agree(s, q, left=True)
                    covered = s + length + self._agree(s + q + length, q)  # the first word that differs from that q later
                    self._keep(a, covered + q, q)
            return
        lo = int(starts[0]) - self._agree(int(starts[0]), q, left=True)
        same = np.flatnonzero(np.diff(np.concatenate(([False], x[lo : self.n - q] == x[lo + q : self.n], [False])).astype(np.int8))) + lo
        a, b = same[::2], same[1::2]
        keep = (b - a >= q) | (b == self.n - q)
        for start, end in zip(a[keep].tolist(), b[keep].tolist()):
            self._keep(start, end + q, q)

    def _keep(self, start: int, end: int, q: int) -> None:
        if end - start >= 2 * q or end == self.n:
            self.runs[start, q] = end


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __init__(self, first: int) -> None:
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.first + len(self)
        return number


def _solve(texts: list[bytes | None], exponent: int, least: int):
    """Words, runs and kept words of a few texts, appended to one catcher.

    No two texts share a word's number, so no run reaches from one into the next.
    """
    split, ids, first = [(t or b"").split() for t in texts], [], 0
    for words in split:
        numbers = _Numbers(first)
        ids += [numbers[w] for w in words]
        first += len(numbers)
    catcher = SquareCatcher()
    catcher.append(np.array(ids, np.int64))
    counts = [len(w) for w in split]
    begin = np.concatenate(([0], np.cumsum(counts)))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in catcher.found(exponent, least):
        i = int(np.searchsorted(begin, start, "right")) - 1
        runs[i].append((start - int(begin[i]), length, q))
    kept = []
    for words, own in zip(split, runs):
        if own:
            keep = np.ones(len(words), bool)
            for start, length, q in own:
                keep[start + q : start + length] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        kept.append(b" ".join(words))
    return counts, runs, kept


SCHEMA = "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"


def _find(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1), 1 << 18):
                counts, runs, kept = _solve(texts, exponent, least)
                flat = [r for own in runs for r in own]
                offsets = np.concatenate(([0], np.cumsum([len(own) for own in runs]))).astype(np.int32)
                fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), listed, pa.array(kept, pa.binary())],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST
) -> DataFrame:
    """One row (doc_id, n_words, runs, collapsed) per row of ``docs``.

    Words end at ASCII white space. ``runs`` lists (start, length, period) of every
    maximal stretch with smallest period ``period`` that holds at least ``least``
    words and ``exponent`` periods (2 or more), by start, then period; ``collapsed``
    is the text without the words of a run after its first period, joined by one
    space. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Rows that repeat a doc_id, or have none, are returned each; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    A text is one sequence and is handled whole by one task; nothing is shuffled.
    """
    if exponent < 2:
        raise ValueError("a run holds its period at least twice")
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = own.mapInArrow(_find(exponent, least), SCHEMA)
    return found.select(F.col("id").alias("doc_id"), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
