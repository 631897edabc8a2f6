"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tgraph.llm import periodic, queries


def brute(x, exponent=4, least=6):
    best = {}
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i < len(x) - q:
            a = i
            while i < len(x) - q and x[i] == x[i + q]:
                i += 1
            if i > a and i - a + q >= max(least, exponent * q):
                best.setdefault((a, i - a + q), q)
            i += 1
    return sorted((a, n, q) for (a, n), q in best.items())


def sequence(rng):
    x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(120))]
    for _ in range(rng.randrange(4) if x else 0):
        a = rng.randrange(len(x))
        p = 1 + rng.randrange(max(1, (len(x) - a) // 2))
        for i in range(a, min(len(x), a + p * rng.randrange(2, 9) + rng.randrange(p))):
            x[i] = x[a + (i - a) % p]
    return x


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 6)])
def test_runs_do_not_depend_on_how_words_are_dealt_out(exponent, least):
    rng = random.Random(exponent)
    for _ in range(400):
        x = sequence(rng)
        want = brute(x, exponent, least)
        for most in (len(x) + 1, 1, 17):
            catcher, i = periodic.SquareCatcher(), 0
            while i < len(x):
                m = rng.randrange(1, most + 1) if most == 17 else most
                catcher.append(np.array(x[i : i + m], np.int64))
                i += m
            assert catcher.found(exponent, least) == want


def test_long_sequences_and_a_square_as_soon_as_it_is_there():
    unit = list(range(700))
    catcher = periodic.SquareCatcher()
    catcher.append(np.array(unit + unit[:-1], np.int64))
    assert catcher.found(2, 2) == []
    catcher.append(np.array(unit[-1:], np.int64))
    assert catcher.found(2, 2) == [(0, 1400, 700)]
    catcher.append(np.array(unit * 3 + [0, 9], np.int64))
    assert catcher.found(4, 6) == [(0, 3501, 700)]
    fib = [0]
    for _ in range(16):  # Fibonacci words: very many squares, none of them a fourth power
        fib = [v for s in fib for v in ((0, 1) if s == 0 else (0,))]
    catcher = periodic.SquareCatcher()
    catcher.append(np.array(fib[:1500], np.int64))
    assert catcher.found(2, 2) == brute(fib[:1500], 2, 2)


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = rewritten(doc_id, (text or "").encode().split())
    runs = brute(words)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (
        doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(None, "a a a a a a a a"), (0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "é\x1cé " * 9), (4, "x y " * 3000), (4, "x y " * 3000), (5, "ab" * 50000)]
    rows += [(10 + i, rng.choice([" ", "\n", " \t"]).join(f"w{v}" for v in sequence(rng))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id bigint, text string, runs int, id string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert all(t == "bigint" for c, t in got.dtypes if c in names[:6])
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
