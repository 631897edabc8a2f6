"""Embedding near-dedup against all pairs; WARC archives there and back."""

import base64
import gzip
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tgraph.llm import embeddup, warc


def groups(rng, dim=16):
    rows = [rng.normal(size=dim) for _ in range(150)]
    for g in range(6):
        base = rng.normal(size=dim)
        rows += [base * rng.uniform(0.1, 9) + 0.06 * rng.normal(size=dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.uniform(0, 5) for _ in range(5 + 20 * (g == 0))]
    return rows


def brute(rows, cosine=0.95):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scaled = [np.array(v) / np.abs(v).max() for _, v in good]
    unit = [v / np.linalg.norm(v) for v in scaled]
    links = {i: 0 for i, _ in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                for x in (a, b):
                    links[good[x][0]] += 1
                x, y = find(good[a][0]), find(good[b][0])
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block", [1024, 8])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddup, "BLOCK", block)
    rows = [(i, v.tolist()) for i, v in enumerate(groups(np.random.default_rng(1)))]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [nan] * 16), (904, [inf] + [1.0] * 15), (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    rows += [(910 + i, rows[0][1]) for i in range(12)] + [(930, [1e-300 * x for x in rows[0][1]]), (931, [1e300 * x for x in rows[3][1]])]
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id bigint, embedding array<double>, n_links int, good string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddup.near_duplicates(table).collect()}
    want = brute(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(got) == len(rows) and all(got[i][0] <= want[i][0] for i in got)
    found, every = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.98 * every and len(wrong) < 0.03 * len(rows)


def test_recall_on_the_test_vectors(spark):
    rng = np.random.default_rng(3)
    base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("embedding").collect()
    rows = [np.array(r.embedding) for r in base]
    for v in rows[:200]:  # a partner at a cosine of 0.95 to 0.99
        c, side = rng.uniform(0.951, 0.99), rng.normal(size=len(v))
        u = v / np.linalg.norm(v)
        side -= (side @ u) * u
        rows.append(c * u + np.sqrt(1 - c * c) * side / np.linalg.norm(side))
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    got = embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert got.n_links.sum() >= 0.95 * sum(n for n, _ in brute(rows).values())


def test_vector_edges(spark):
    rows = spark.createDataFrame([(None, [1.0]), (None, [1.0]), (5, [1.0]), (5, [1.0]), (4, [3.0])], "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, embeddup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (5, 2, 4, False), (5, 2, 4, False), (4, 2, 4, True)], key=str)
    assert embeddup.near_duplicates(rows.where("false")).count() == 0


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("least", [0, 4])
def test_archives_there_and_back(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)  # several archives
    html = ["<p>é😀</p>", "", None, "same page", "same page", "tiny", "x", "x", "line\r\n\r\nWARC/1.1\r\n"] + [f"page {i} " * (i % 40) for i in range(60)]
    rows = [(i, f"http://h/{i}\r\nX: y" if i != 5 else None, h) for i, h in enumerate(html)] + [(None, "http://n", "same page"), (3, "http://again", "same page")]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id bigint, url string, html string, digest int, archive string")
    folder = str(tmp_path)
    index = warc.write(pages, folder, least_bytes=least)
    assert index.select("file").distinct().count() > 1
    largest = {}
    for i, _, h in rows:
        data = (h or "").encode()
        largest[data] = max(largest.get(data, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = len(data) < least or (i is not None and i == largest[data])
        want.append((i, len(data), digest(data), "response" if first else "revisit", None if first else largest[data]))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.read(index, folder, payloads=True)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)
    text = {r.page_id: r.payload for r in got.where("record_type = 'response'").collect()}
    assert text[0].decode() == html[0] and text[8].decode() == html[8]
    some = warc.read(index.where("page_id % 7 = 0"), folder).select("page_id").collect()
    assert sorted(r.page_id for r in some) == sorted(i for i, _, _ in rows if i is not None and i % 7 == 0)
    for file in tmp_path.glob("*.warc.gz"):
        raw = gzip.open(file).read()  # plain readers see records one after the other
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        for r in index.where(F.col("file") == file.name).collect():
            fields, _, _ = warc.parse(file.read_bytes()[r.offset : r.offset + r.length])
            assert fields["WARC-Payload-Digest"] == f"sha1:{r.digest}"
    assert not list(tmp_path.glob(".*")) or all(re.search(r"\.crc$", str(p)) for p in tmp_path.glob(".*"))


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    index = warc.write(pages, str(tmp_path))
    assert index.count() == 0 and warc.read(index, str(tmp_path)).count() == 0


def test_ranges_are_joined():
    assert warc.ranges([(0, 10), (10, 10), (100, 10)], gap=50, most=100) == [(0, 2, 0, 20), (2, 3, 100, 110)]
    assert warc.ranges([(0, 10), (10, 95), (105, 200)], gap=50, most=100) == [(0, 1, 0, 10), (1, 2, 10, 105), (2, 3, 105, 305)]
    assert warc.ranges([]) == []
