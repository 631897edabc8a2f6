"""Spelling variants against all edits of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tgraph.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, every=31):
    out = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def brute(counts, times=10):
    near = {}
    for w in counts:
        near[w] = [v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and one_edit(w, v)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def text(rng, stems):
    out = []
    for _ in range(rng.randrange(80)):
        w = list(stems[min(int(rng.paretovariate(0.6)) - 1, len(stems) - 1)])
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "é", "ß", "z", "×", "bb"])
        out.append(rng.choice([str.lower, str.upper, str.title])("".join(w)) if rng.random() < 0.3 else "".join(w))
    return rng.choice([" ", "-", "1"]).join(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_query_equals_all_pairs(spark, monkeypatch, tmp_path, parts):
    rng = random.Random(parts)
    stems = ["banana" * 2, "grünlich", "Éternité", "aaaaaaaa", "abcdefgh", "letters", "letterss", "x" * 70, "spelling", "ÀÁÂÃÄÅÆ"]
    rows = [(None, text(rng, stems)), (0, None), (1, ""), (2, "123 ..."), (3, "w" * 3000 + " " + "w" * 2999 + "v"), (3, "w" * 3000), (4, "w" * 2999 + "v")]
    rows += [(rng.randrange(10, 200), text(rng, stems)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id bigint, text string, word int, n string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    counts = {w: n for w, n in words_of(rows).items() if len(w) >= 7 and n >= 2}
    monkeypatch.setattr(spelling, "CAPACITY", -(-len(counts) // parts))  # filters in several rounds
    monkeypatch.setattr(spelling, "ROWS", 50)
    got = queries.op13_spelling(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(counts)
    assert got.count() == len(counts)


def test_chains_repeated_rows_and_empty_tables(spark):
    schema = "word string, n bigint"
    rows = [("kittens", 1), ("kitten", 10), ("mitten", 100), ("mitte", 1000), ("mitte", 0), (None, 5), ("lone", None), ("", 3), ("a", 40)]
    got = {tuple(r) for r in spelling.group_variants(spark.createDataFrame(rows, schema)).collect()}
    assert got == brute({"kittens": 1, "kitten": 10, "mitten": 100, "mitte": 1000, "": 3, "a": 40})
    assert {r[0]: r[2] for r in got}["kittens"] == "mitte"
    assert spelling.group_variants(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame(rows, schema), times=1)


def test_filters_hold_every_word_and_are_bounded(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([7, 8, 80]))) for _ in range(5000)]
    own = spark.createDataFrame([(w, 2) for w in set(words)], "word string, n bigint").mapInArrow(spelling._hash, "word string, n bigint, key bigint")
    counts = Counter(min(len(w), spelling.LONGEST_SHARD) for w in set(words))
    filters = spelling._filters(own, counts, 0, 1)
    assert sum(len(f) for f in filters.values()) <= len(set(words)) * spelling.BITS / 64 + len(counts)
    import numpy as np

    for r in own.collect():
        key = np.array([r.key], np.int64).view(np.uint64)
        bloom = filters[spelling._shard(len(r.word))]
        mask = spelling._mask(key)
        assert (bloom[spelling._block(key, len(bloom))] & mask) == mask
