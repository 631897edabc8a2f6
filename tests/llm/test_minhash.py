"""Near-duplicates against all pairs, and the parts they are made of."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tgraph.llm import minhash, textnum
from tgraph.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, k, percent=80):
    """component of each doc_id; rows of one id link whatever one of them links."""
    parent = {i: i for i, _ in rows if i is not None}
    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = find(parent, i), find(parent, j)
            parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in parent}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, "a b"), (7, "A\tB"), (8, "é b"), (9, "É b")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 20, 60, 200]))]
        for c in range(rng.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 15))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + 40 * g + c, rng.choice([" ", "\n", "  "]).join(own)))
    rows += [(700, rows[-1][1]), (700, rows[20][1]), (701, rows[20][1]), (None, rows[20][1]), (702, rows[20][1]), (702, rows[20][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "members"), [(2, 512), (2, 6), (5, 512)])
def test_equals_all_pairs(spark, monkeypatch, k, members):
    monkeypatch.setattr(minhash, "MEMBERS", members)  # small blocks: neighbourhoods fall in many
    rows = corpus()
    # columns called like inner ones are ignored
    docs = spark.createDataFrame([(i, t, 7, True, "x") for i, t in rows], "doc_id bigint, text string, component_id int, kept boolean, key string")
    got = minhash.near_duplicates(docs, k=k).collect()
    want = brute(rows, k)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t, k)) for _, t in rows)


def test_empty_table_and_bound(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(docs).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, similarity=70)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randrange(1, 9) + str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 700, 30)] + ["y" * 5000, None]
    whole = textnum.shingles(texts, 3)
    monkeypatch.setattr(textnum, "PIECE", 256)
    cut = textnum.shingles(texts, 3)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert whole[1].tolist() == [len(shingle_set(t, 3)) for t in texts]


def test_keys_meet_within_the_radius():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (200, minhash.SYMBOLS), dtype=np.uint8)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)
        row[at] ^= rng.integers(1, 256, len(at), dtype=np.uint8)
    ka, kb = minhash.chunk_keys(a), minhash.chunk_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka, kb))


@pytest.mark.parametrize("size", [2048, 16])
def test_runs_of_a_large_group_return_few_links(spark, monkeypatch, size):
    """Near copies of one text, many too far for a link: runs that are not one component."""
    monkeypatch.setattr(minhash, "RUN", size, raising=False)  # small: runs in parts
    monkeypatch.setattr(minhash, "MEMBERS", 16)
    rng = np.random.default_rng(6)
    symbols = np.repeat(rng.integers(0, 256, (1, minhash.SYMBOLS), dtype=np.uint8), 240, 0)
    for row in symbols:
        at = rng.choice(minhash.SYMBOLS, rng.integers(0, 40), replace=False)
        row[at] = rng.integers(0, 256, len(at), dtype=np.uint8)
    rows = [(i, i, int(rng.integers(90, 120)), i, *map(int, x.view("<i8"))) for i, x in enumerate(symbols)]
    rows.append((-1, -1, 100, 7, *map(int, symbols[9].view("<i8"))))  # a repeated doc_id heads two classes
    names = ", ".join(f"{w} bigint" for w in minhash.WORDS)
    classes = spark.createDataFrame(rows, f"d1 bigint, d2 bigint, n_shingles bigint, doc_id bigint, {names}")
    own, n = [r[3] for r in rows], [r[2] for r in rows]
    parent = {i: i for i in own}
    every = np.concatenate((symbols, symbols[9:10]))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (every[i] != every[j]).sum() <= minhash.RADIUS and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]):
            x, y = find(parent, own[i]), find(parent, own[j])
            parent[max(x, y)] = min(x, y)
    given = []
    monkeypatch.setattr(minhash, "components", lambda links: given.append(links.count()) or components(links))
    got = dict(minhash._neighbourhoods(classes, classes.select("doc_id", "n_shingles", *minhash.WORDS), 80).collect())
    assert {i: got.get(i, i) for i in parent} == {i: find(parent, i) for i in parent}
    assert len(set(got.values())) < len(got)
    # a spanning set of each of four tasks and each of two rounds, not pairs
    assert max(given) < 8 * len(rows)
    assert len(given) == (1 if size == 2048 else 2)


def test_slabs_do_not_cut_runs(monkeypatch):
    monkeypatch.setattr(minhash, "ROWS", 7)
    rng = np.random.default_rng(7)
    key = np.sort(rng.integers(0, 12, 100))
    ids = rng.permutation(100)
    words = rng.integers(0, 3, (1, 8)).repeat(100, 0)
    table = pa.table({"key": key, "part": key * 0, "id": ids, "component": ids, "n_shingles": key * 0 + 9} | {w: words[:, i] for i, w in enumerate(minhash.WORDS)})
    out = pa.Table.from_batches(minhash._compare(80)(iter(table.to_batches(max_chunksize=5))))
    # equal signatures: each run is one tree
    assert out.num_rows == 100 - len(set(key.tolist()))
    at = dict(zip(ids.tolist(), key.tolist()))
    assert all(at[a] == at[b] for a, b in zip(*(c.to_pylist() for c in out.columns)))


def test_native_distance(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, (2, 50, minhash.SYMBOLS), dtype=np.uint8)
    rows = [(*map(int, x.view("<i8")), *map(int, y.view("<i8"))) for x, y in zip(a, b)]
    names = [f"a{i}" for i in range(8)] + [f"b{i}" for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    both = df.selectExpr(*(f"struct({', '.join(f'{t}{i} as s{i}' for i in range(8))}) as {t}" for t in "ab"))
    got = [r[0] for r in both.select(minhash.distance("a", "b")).collect()]
    assert got == (a != b).sum(1).tolist()


def test_distance_of_arrays():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, (2, 50, minhash.SYMBOLS), dtype=np.uint8)
    assert minhash.apart(a.view(np.uint64), b.view(np.uint64)).tolist() == (a != b).sum(1).tolist()


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {i: i for e in edges for i in e if i is not None}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    linked = {i for a, b in edges if a is not None and a != b for i in (a, b)}
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: find(parent, i) for i in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
