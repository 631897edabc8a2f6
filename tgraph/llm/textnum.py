"""Vectorised hashing of words and shingles, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19  # bytes handled at once; longer texts are cut between words
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        one = np.ones(1, np.uint64)
        _POW[:] = [np.concatenate((one, np.multiply.accumulate(np.full(size - 1, p)))) for p in (_BASE, inverse)]
    return _POW[0], _POW[1]


def _piece_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start
    up, down = _powers(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` (A-Z lower-cased, cut at ASCII white
    space), one text after the other, and the number of words of each."""
    out, counts, pending, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal size
        if pending:
            # a separator byte keeps words of two texts apart
            own, start = _piece_hashes(b" ".join(raw for _, raw in pending))
            ends = np.cumsum([len(raw) + 1 for _, raw in pending])
            for (i, _), c in zip(pending, np.diff(np.searchsorted(start, ends), prepend=0)):
                counts[i] += c
            out.append(own)
            pending.clear()
            size = 0

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        while len(raw) > PIECE:
            cut = PIECE
            while cut < len(raw) and raw[cut] not in b" \t\n\r\x0b\x0c":
                cut += 1
            flush()
            pending.append((i, raw[:cut]))
            raw = raw[cut:]
        if size + len(raw) > PIECE:
            flush()
        pending.append((i, raw))
        size += len(raw)
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``k``-word shingles of every text, sorted within it, and
    their number. A text with fewer words, but not none, is one shingle."""
    words, n = word_hashes(texts)
    n_sh = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    doc = np.repeat(np.arange(len(n)), n_sh)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + first[doc]
    value = np.zeros(len(doc), np.uint64)
    for j in range(k):
        has = j < n[doc]
        w = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else value
        value = np.where(has, value * np.uint64(0xC2B2AE3D27D4EB4F) + w, value)
    value = mix(value + np.minimum(n[doc], k).astype(np.uint64))
    ends = np.cumsum(n_sh)
    for a, z in zip((ends - n_sh).tolist(), ends.tolist()):
        value[a:z].sort()
    keep = np.ones(len(doc), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.bincount(doc[keep], minlength=len(n)).astype(np.int64)


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """Consecutive runs (begin, end, texts) of a text column, of at most ``most``
    bytes or of one text, so that a batch's texts are not all held as objects."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end
