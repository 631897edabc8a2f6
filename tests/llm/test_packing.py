"""Packing: ids against the plain tokenizer, plans against their bounds, and a round trip."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tgraph.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = (
    "don't It's l'été É é à 12ab1 __ a_b × ÷ ... (a) é! 's ''s 你好 가 ́ ﬁ Ａ 😀👍🏽 𝒜 ½² ŉ K Å (a). hello, WORLD!! ; İstanbul a'sb ß Σας ΑΣ "
    "<|endoftext|> <|startoftext|>x x<|endoftext|>y"
).split() + ["\t", "\n", "\x0b", "\x1c", "\x85", " ", " ", "q" * 70, "Å" * 80, "ab" * 3000]


def test_ids_equal_the_plain_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 60)  # a cache that runs over
    monkeypatch.setattr(packing, "PIECE", 5000)  # and texts in pieces
    encoder, plain, rng = packing._Encoder(PATH), Tokenizer.from_file(PATH), random.Random(2)
    pool = [*ODD, *"'\"<>|_^`~#$%&*+-=/\\@[]{}0129aZéÉß"]
    texts = []
    for n in [0, 1, 2, 5, 14] * 100 + [30000]:
        odd = pool if n < 100 else [p for p in pool if len(p) < 70]
        texts.append("".join(rng.choice(odd) + rng.choice([" ", "", "\n"]) for _ in range(n)))
    texts += ["".join(rng.choice("abZ .,'!<|>9\t") for _ in range(60)) for _ in range(300)] + ["plain words, only. " * 900]
    rng.shuffle(texts)
    for lo in range(0, len(texts), 50):
        some = texts[lo : lo + 50]
        got = encoder.ids([t.encode() for t in some])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in some]
    assert encoder.ids([None, b""]) == [b"", b""]


def test_least_squares_are_non_negative_and_settled():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)) * (rng.random((12, 30)) < 0.3), rng.random(12) * 10
        x = packing.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 100, 4096])
    counts = Counter(min(capacity, 1 + int(rng.paretovariate(0.7) * rng.choice([1, 9, 40]))) for _ in range(rng.choice([1, 50, 5000])))
    made = packing.plan(dict(counts), capacity)
    held = Counter()
    for own, times in made:
        assert sum(own) <= capacity and times > 0
        for n in own:
            held[n] += times
    assert held == counts
    used, total = sum(t for _, t in made), sum(n * c for n, c in counts.items())
    assert used <= 2 * total / capacity + 1
    # thousandfold counts: the same shapes, hardly more entries
    assert len(packing.plan({n: 1000 * c for n, c in counts.items()}, capacity)) <= len(made) + 4 * len(counts)


def test_patterns_fill_a_sequence():
    shapes = packing.patterns(16, 4)
    assert len(set(shapes)) == len(shapes) and all(sum(s) == 16 + len(s) // 2 for s in shapes)
    assert all(list(s) == sorted(s, reverse=True) and s[0] <= 16 for s in shapes)


def test_query_and_round_trip(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "one two"), (0, None), (1, ""), (2, " \n"), (3, "word " * 9000), (3, "word " * 9000), (4, "x" * 40000), (5, "a " * 4095), (6, "a " * 4096)]
    rows += [(10 + i, " ".join(rng.choice(ODD[:40]) for _ in range(rng.randrange(900)))) for i in range(120)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id bigint, text string, length int, _part string").repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_packing(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[i, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        ends = 0
        for offset, n in sorted(held):
            assert offset == ends
            ends += n
        assert ends <= 4096
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 4096) + 2
    # real sequences
    whole = packing.sequences(packing.pack(docs, PATH)).collect()
    assert sum(len(r.ids) for r in whole) == total and len(whole) == len(by_sequence)
    first = next(r for r in whole if 5 in r.doc_ids)
    at = first.starts[first.doc_ids.index(5)]
    assert first.ids[at : at + 4096] == [*plain.encode("a " * 4095, add_special_tokens=False).ids, 1]
    assert packing.pack(docs.limit(0), PATH).count() == 0
