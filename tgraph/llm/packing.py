"""Packing of tokenised documents into sequences by patterns of lengths.

Documents are tokenised inside tasks and cut into pieces of at most the capacity.
What decides the packing is the histogram of piece lengths alone, which has no
more rows than the capacity. Few-piece patterns that fill a sequence are enumerated
over bins of lengths; non-negative least squares fits the patterns' repeats to
the histogram, which are rounded down and carried out with exact lengths; the
residual is packed largest first. The plan says for each rank within a length which
sequence and offset it gets, so a piece finds its place by its length and rank.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tgraph.llm.textnum import slices
from tgraph.session import materialize

CAPACITY = 4096
END = 1  # the id after each document
BINS = 64  # of lengths, for the fit
MOST = 4  # pieces of a pattern
CACHE = 1 << 20  # parts of texts whose ids a worker keeps
LONGEST = 64  # characters of a part that is kept
PIECE = 1 << 20  # bytes of a text handled at once

# letters of one code point in NFC, digits, white space, and punctuation but apostrophes and what begins control strings
_ODD = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{-~ \t-\r]").search
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+").findall
_WORKERS: dict[str, _Encoder] = {}


class _Encoder:
    """Ids of texts, as little-endian bytes, by way of the tokenizer's ids of their parts.

    The tokenizer lower-cases, and never joins what white space separates, nor letters,
    digits and punctuation. So these are the parts of plain text; of other text, the
    parts are what white space separates. The ids of a part are asked for once and kept.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        plain, odd = [p for p in parts if not _ODD(p)], [p for p in parts if _ODD(p)]
        for lo in range(0, len(odd), 1024):
            some = odd[lo : lo + 1024]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[part] = np.array(found.ids, "<u4").tobytes()
        for lo in range(0, len(plain), 4096):
            # plain parts many at a time: the tokens that end a word tell them apart
            some = plain[lo : lo + 4096]
            ids, start, n = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, 0, 0
            raw = np.array(ids, "<u4").tobytes()
            for i, token in enumerate(ids):
                if token in self.ends:
                    self.known[some[n]] = raw[4 * start : 4 * i + 4]
                    start, n = i + 1, n + 1

    @staticmethod
    def _split(text: str) -> list[str]:
        if not _ODD(text):
            return _PARTS(text.lower())
        out = []
        for chunk in text.encode().split():
            part = chunk.decode()
            if _ODD(part):
                out.append(part)
            else:
                out += _PARTS(part.lower())
        return out

    def _some(self, texts: list[bytes]) -> list[bytes]:
        split = [self._split(t.decode()) for t in texts]
        every = set().union(*split)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, list(every)
        self._learn(new)
        known = self.known
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        out, held, size = [], [], 0
        for text in texts:
            raw, cut = text or b"", []
            while len(raw) > PIECE:  # a long text in pieces, between white space
                at = PIECE
                while at < len(raw) and raw[at] not in b" \t\n\r\x0b\x0c":
                    at += 1
                cut += self._some([raw[:at]])
                raw = raw[at:]
            if cut:
                out += self._some(held)
                held, size = [], 0
                out.append(b"".join([*cut, *self._some([raw])]))
                continue
            held.append(raw)
            size += len(raw)
            if size > PIECE:
                out += self._some(held)
                held, size = [], 0
        return out + self._some(held)


def _encoder(path: str) -> _Encoder:
    if path not in _WORKERS:
        _WORKERS[path] = _Encoder(path)
    return _WORKERS[path]


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1), 1 << 20):
                rows, ids = [], batch.column(0).slice(lo, hi - lo).to_pylist()
                for doc_id, raw in zip(ids, encoder.ids(texts)):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc_id, k, at // 4, n, zlib.crc32(own), part, ranks[n], own))
                        ranks[n] += 1
                columns = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 5))]
                if with_ids:
                    starts = np.concatenate(([0], np.cumsum(columns[3]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(columns[7]), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, [*_PIECE, "ids"][: len(arrays)])

    return run


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"]


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, [ids]) per piece of a document.

    A document is its text's ids by the tokenizer file at ``path``, without special
    tokens, then ``end``. Only longer ones are cut, every ``capacity`` tokens. Null and empty texts
    are the id ``end`` alone. Rows that repeat a doc_id, or have none, are documents
    each; other columns are ignored. ``_part`` and ``_rank`` number the task's
    pieces of each length and are for ``place``.
    """
    own = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _part bigint, _rank bigint"
    return own.mapInArrow(_cut(path, capacity, end, with_ids), schema + (", ids array<int>" if with_ids else ""))


def patterns(bins: int = BINS, most: int = MOST) -> list[tuple[int, ...]]:
    """Descending lists of at most ``most`` bins (1 to ``bins``) that fill a sequence.

    Pieces lie half a bin below their bin's upper end on average, so ``k`` of them
    fill a sequence if their bins add up to ``k / 2`` more than there are.
    """
    out = []

    def grow(head: tuple[int, ...], left: int, largest: int) -> None:
        if head and left <= 0:
            if left == 0:
                out.append(head)
            return
        if len(head) < many:
            for b in range(min(left, largest), 0, -1):
                if b * (many - len(head)) < left:
                    break
                grow((*head, b), left - b, b)

    for many in range(1, most + 1):
        done = len(out)
        grow((), bins + many // 2, bins)
        out[done:] = [p for p in out[done:] if len(p) == many]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative x of least ||a x - b||, by an active set: the most promising
    column enters, and columns that a solution would make negative leave."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max()))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        passive[j] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                x = s
                break
            low = passive & (s <= 0)
            step = float((x[low] / np.maximum(x[low] - s[low], 1e-300)).min())
            x = x + step * (s - x)
            passive &= x > 1e-12 * max(1.0, float(x.max()))
            x[~passive] = 0
            if not passive.any():
                break
    return x


class _Stock:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.count)

    def fitting(self, room: int, least: int = 1) -> int:
        """The largest length from ``least`` to ``room``, or 0."""
        i = bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i and self.lengths[i - 1] >= least else 0

    def take(self, n: int, times: int) -> None:
        self.count[n] -= times
        if not self.count[n]:
            del self.count[n]
            self.lengths.pop(bisect_right(self.lengths, n) - 1)

    def use(self, pattern: list[int], most: int) -> int:
        """Take the pattern as often as it can be had."""
        times = min([most, *(self.count[n] // pattern.count(n) for n in set(pattern))])
        for n in pattern:
            if times:
                self.take(n, times)
        return times


def _exact(stock: _Stock, pattern: tuple[int, ...], repeats: int, width: int, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences without a gap, by a pattern of bins: any pieces of all bins but
    the last, and one there, or next to it, that fills the rest."""
    out = []
    while repeats:
        own, room, held = [], capacity, defaultdict(int)
        for b in pattern[:-1]:
            n = stock.fitting(min(b * width, room), (b - 1) * width + 1)
            while n and stock.count[n] <= held[n]:  # a length's last piece is in the pattern already
                n = stock.fitting(n - 1, (b - 1) * width + 1)
            if not n:
                return out
            own.append(n)
            held[n] += 1
            room -= n
        if room:
            last = stock.fitting(room)
            if last != room or stock.count[last] <= held[last]:
                # another piece of the bin before
                last, found = 0, False
                b, tried = pattern[-2] if len(pattern) > 1 else 0, own[-1] if own else 0
                while b and not found:
                    tried = stock.fitting(tried - 1, (b - 1) * width + 1)
                    if not tried:
                        break
                    rest = room + own[-1] - tried
                    trial = [*own[:-1], tried, rest]
                    found = all(stock.count.get(n, 0) >= trial.count(n) for n in set(trial))
                if not found:
                    return out
                own = trial
            else:
                own.append(last)
        times = stock.use(own, repeats)
        out.append((tuple(own), times))
        repeats -= times
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences) for all pieces.

    Its size follows the number of different lengths, not of pieces: every entry
    but those of a rounded pattern uses up a length, or leaves too little of it.
    """
    out = []
    stock = _Stock(counts)
    if stock.count.get(capacity):
        times = stock.count[capacity]
        stock.take(capacity, times)
        out.append(((capacity,), times))
    width = -(-capacity // BINS)
    bins = -(-capacity // width)
    shapes = patterns(bins)
    table = np.zeros((bins, len(shapes)))
    for j, shape in enumerate(shapes):
        for b in shape:
            table[b - 1, j] += 1
    have = np.zeros(bins)
    for n, c in stock.count.items():
        have[-(-n // width) - 1] += c
    fit = np.floor(nnls(table, have) + 1e-6).astype(np.int64)
    for j in np.argsort([-shapes[j][0] for j in range(len(shapes))], kind="stable").tolist():
        if fit[j]:
            out += _exact(stock, shapes[j], int(fit[j]), width, capacity)
    while stock.count:
        own, room = [], capacity
        n = stock.fitting(room)
        while n:
            times = min(stock.count[n], room // n)
            own += [n] * times
            room -= n * times
            n = stock.fitting(min(room, n - 1))
        out.append((tuple(own), stock.use(own, max(stock.count.values()))))
    return out


def _places(made: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Per interval of ranks of a length: its key, first rank, first sequence and offset."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for own, times in made:
        offset = 0
        for n in own:
            rows.append((n, used[n], first, offset))
            used[n] += times
            offset += n
        first += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def _put(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rank, sequence, offset = shared.value
        border = np.searchsorted(n, np.arange(int(n.max()) + 2)) if len(n) else np.zeros(2, np.int64)
        for batch in batches:
            length, own = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for group in np.split(order, edges) if len(order) else []:
                lo, hi = border[length[group[0]]], border[length[group[0]] + 1]
                at[group] = lo + np.searchsorted(rank[lo:hi], own[group], "right") - 1
            arrays = [*batch.columns, pa.array(sequence[at] + own - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "sequence_id", "offset"])

    return run


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Columns of ``cut``, with the sequence and the offset of every piece.

    ``cut`` are the written rows of ``pieces``. Pieces of one length are told apart by
    their task and its own count of them, made global by a running sum over
    one row per task and length. An empty table gives an empty result.
    """
    per_task = cut.groupBy("length", "_part").count()
    w = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a length's rows are as many as tasks
    before = per_task.select(F.col("length").alias("_n"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    counts = {r.length: r["sum(count)"] for r in per_task.groupBy("length").sum("count").collect()}
    shared = cut.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity), capacity))
    ranked = cut.join(before, (cut.length == F.col("_n")) & (cut._part == F.col("_p")))
    ranked = ranked.select(*[c for c in cut.columns if c != "_rank"], (F.col("_rank") + F.col("_before")).alias("_rank"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(_put(shared), f"{types}, sequence_id bigint, offset bigint").drop("_part", "_rank")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the packed sequences; needs pieces with their ids.

    A sequence has at most ``capacity`` tokens, hence no more pieces.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    out = placed.groupBy("sequence_id").agg(rows.alias("r"))
    return out.select("sequence_id", F.flatten("r.ids").alias("ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("starts"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: ``pieces``, written, then ``place``."""
    return place(materialize(pieces(docs, path, capacity, end, with_ids), "pieces"), capacity)
