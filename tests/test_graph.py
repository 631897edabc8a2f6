"""Graph operators on small graphs, next to brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import features
from tgraph.operators import graphstats as gs
from tgraph.operators import neighbors as nb
from tgraph.operators import proximity as px
from tgraph.operators import subgraph as sg
from tgraph.operators import walks as wk
from tgraph.plans import base

PATH5 = [(1, 2, 1), (2, 3, 2), (3, 4, 3), (4, 5, 4)]
TRI2 = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 2)]
STAR = [(0, i, i) for i in range(1, 9)]


def random_edges(n, m, seed):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b), int(i // 2)) for i, (a, b) in enumerate(rng.integers(0, n, (m, 2))) if a != b]


def test_hops_and_diameter(graph):
    adj = gs.symmetric_adjacency(graph(PATH5))
    roots = adj.select(F.col("node").alias("root")).distinct()
    d = {(r["root"], r["node"]): r["hops"] for r in gs.hop_distances(adj, roots).collect()}
    assert d == {(a, b): abs(a - b) for a in range(1, 6) for b in range(1, 6)}
    assert gs.estimate_diameter(adj, 6, 200, "s") == 4.0


def test_farthest_hops_equal_a_search_by_rows(graph):
    # a long path with a star at its end, a circle, a pair, and roots that are not there
    rows = [(i, i + 1, i) for i in range(70)] + [(70, 200 + i, i) for i in range(30)] + [(300 + i, 300 + (i + 1) % 9, i) for i in range(9)]
    adj = gs.symmetric_adjacency(graph([*rows, (400, 401, 1), (500, 500, 1), *random_edges(40, 60, 2)]))
    roots = [*range(0, 240, 2), *range(300, 309), 400, 401, 500, 999]
    full = gs.hop_distances(adj, adj.sparkSession.createDataFrame([(r,) for r in roots], "root bigint"))
    want = {r["root"]: r["far"] for r in full.filter("hops > 0").groupBy("root").agg(F.max("hops").alias("far")).collect()}
    assert gs.farthest_hops(adj, roots) == want
    assert gs.farthest_hops(adj, roots, task_links=0) == want


def test_hops_of_pairs_equal_a_full_search(graph):
    path = [(i, i + 1, i) for i in range(10)]
    star = [(100, 101 + i, i) for i in range(300)]
    e = graph(path + star + [(500, 501, 1)] + [(a + 600, b + 600, t) for a, b, t in random_edges(40, 60, 8)])
    e = e.withColumn("snapshot_id", F.lit(3))
    adj = gs.symmetric_adjacency(e, ("snapshot_id",))
    ids = [r["node"] for r in adj.select("node").distinct().collect()]
    full = {(r["root"], r["node"]): r["hops"] for r in gs.hop_distances(adj, adj.select("snapshot_id", F.col("node").alias("root")).distinct(), None, ("snapshot_id",)).collect()}
    rng = np.random.default_rng(5)
    rows = [(3, g, *(int(x) for x in rng.choice(ids, 2))) for g in range(900)]
    rows += [(3, 1000, 0, 10), (3, 1001, 3, 10), (3, 1001, 9, 0), (3, 1002, 101, 102), (3, 1003, 0, 500), (3, 1004, 9999, 0), (3, 1005, 7, 7), (3, 1006, 9999, 9999)]
    asked = e.sparkSession.createDataFrame(rows, "snapshot_id int, g bigint, root bigint, node bigint")
    got = {r["g"]: r["hops"] for r in gs.nearest_hops(adj, asked, ["g"], ("snapshot_id",)).collect()}
    want = {}
    for _, g, a, b in rows:
        d = 0 if a == b else full.get((a, b))
        if d is not None:
            want[g] = min(d, want.get(g, d))
    assert got == want and want[1000] == 10 and want[1001] == 7 and want[1002] == 2


def test_star_degrees(graph):
    d = {r["node_id"]: r["degree"] for r in gs.degrees(graph(STAR)).collect()}
    assert d == {0: 8, **{i: 1 for i in range(1, 9)}}


def test_two_triangles(graph):
    e = graph(TRI2).withColumn("snapshot_id", F.lit(0))
    assert gs.triangles(gs.symmetric_adjacency(e)).count() == 2
    row = gs.snapshot_properties(e).first()
    assert row["components"] == 1 and row["num_edges"] == 7
    assert row["transitivity"] == pytest.approx(6 / 10)
    labels = {r["node_id"]: r["cluster"] for r in gs.label_propagation(gs.symmetric_adjacency(e)).collect()}
    assert labels[0] == labels[1] == labels[2] and labels[3] == labels[4] == labels[5]
    assert labels[0] != labels[3]


def test_components_and_eigenvalues(graph):
    e = graph(random_edges(40, 60, 3))
    adj = gs.symmetric_adjacency(e)
    got = {r["node"]: r["label"] for r in gs.components(adj).collect()}
    links = [(r["src"], r["tgt"]) for r in e.collect()]
    want = {v: v for p in links for v in p}
    for _ in range(50):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    nodes = sorted(want)
    a = np.zeros((len(nodes),) * 2)
    for u, v in links:
        i, j = nodes.index(u), nodes.index(v)
        a[i, j] += 1
        a[j, i] += 1
    d = a.sum(1)
    exact = np.sort(np.linalg.eigvalsh((np.eye(len(nodes)) + a / np.sqrt(np.outer(d, d))) / 2))[::-1]
    assert gs.leading_eigenvalues(adj, 4, rounds=25, seed="e")[:2] == pytest.approx(exact[:2], abs=1e-3)


def test_snapshot_properties_write_no_table_a_round(graph, monkeypatch):
    """The number of tables, and so of jobs, does not grow with the length of a snapshot's paths."""
    made, write = [], gs.materialize
    monkeypatch.setattr(gs, "materialize", lambda df, label="table": made.append(label) or write(df, label))
    counts = []
    for length in (3, 120):
        links = [(s * 1000 + int(i), s * 1000 + int(i) + 1, s) for s in range(3) for i in np.random.default_rng(s).permutation(length)]
        e = graph(links).withColumn("snapshot_id", F.col("t"))
        rows = gs.snapshot_properties(e).collect()
        assert sorted((r["snapshot_id"], r["num_nodes"], r["num_edges"], r["components"]) for r in rows) == [(s, length + 1, length, 1) for s in range(3)]
        counts.append(len(made))
        made.clear()
    assert counts[0] == counts[1] < 9


def test_components_in_tasks_equal_rounds(graph):
    # chains that cross, in groups below and above the bound
    links = [(int(a), int(b), 0) for a, b in np.random.default_rng(4).permutation(300).reshape(-1, 2)]
    links += [(i, i + 1, 0) for i in range(400, 520)] + [(7, 7, 0), (600, 600, 0)]
    e = graph(links).withColumn("g", F.when(F.col("edge_pos") % 9 == 0, "a").when(F.col("edge_pos") < 150, "b").otherwise("c"))
    adj = gs.symmetric_adjacency(e, ("g",))
    ends = [(r["g"], r["src"], r["tgt"]) for r in e.collect()]
    want = {(g, v): v for g, *pair in ends for v in pair}
    for _ in range(130):
        for g, a, b in ends:
            want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    for bound in (2_000_000, 60, 5):
        got = [(r["g"], r["node"], r["label"]) for r in gs.components(adj, ("g",), bound).collect()]
        assert sorted(got) == sorted((*k, v) for k, v in want.items())
    one = [tuple(r) for r in gs.components(gs.symmetric_adjacency(e), (), 40).collect()]
    assert sorted(one) == sorted(tuple(r) for r in gs.components(gs.symmetric_adjacency(e)).collect())


def dense_spectrum(links):
    """Eigenvalues of (I + A_sym) / 2, the largest first."""
    nodes = sorted({v for p in links for v in p})
    a = np.zeros((len(nodes),) * 2)
    for u, v in links:
        i, j = nodes.index(u), nodes.index(v)
        a[i, j] += 1
        a[j, i] += 1
    d = a.sum(1)
    return np.sort(np.linalg.eigvalsh((np.eye(len(nodes)) + a / np.sqrt(np.outer(d, d))) / 2))[::-1]


def test_eigengap_counts_more_than_eight_communities(graph):
    links = [(6 * c + i, 6 * c + j, 0) for c in range(12) for i in range(6) for j in range(i)]
    links += [(6 * c, (6 * c + 7) % 72, 0) for c in range(12)]
    adj = gs.symmetric_adjacency(graph(links))
    exact = dense_spectrum([x[:2] for x in links])
    assert gs.eigengap(adj) == 12
    assert gs.leading_eigenvalues(adj, 51, seed="e") == pytest.approx(exact[:51], abs=1e-9)
    # the same without the dense solve
    assert gs.leading_eigenvalues(adj, 13, seed="e", dense_nodes=0) == pytest.approx(exact[:13], abs=1e-6)
    with pytest.raises(RuntimeError, match="not settled"):
        gs.leading_eigenvalues(adj, 13, rounds=1, seed="e", dense_nodes=0)


def test_eigenvalues_of_many_chains_settle(graph):
    # 40 chains of 30 nodes, whose ends meet at random: the leading eigenvalues lie close together
    rng = np.random.default_rng(3)
    chains = [(c * 30 + i, c * 30 + i + 1, 0) for c in range(40) for i in range(29) for _ in range(3)]
    ends = [(int(a) * 30 + 29, int(b) * 30, 0) for a, b in rng.integers(0, 38, (120, 2))]
    adj = gs.symmetric_adjacency(graph([*chains, *ends]))
    exact = gs.leading_eigenvalues(adj, 25)
    # two chains are apart, so the largest eigenvalue is threefold
    assert exact[2] == pytest.approx(1) and exact[3] < 1 - 1e-4
    assert gs.leading_eigenvalues(adj, 25, seed="e", dense_nodes=100) == pytest.approx(exact, abs=1e-6)


def test_community_count_is_that_of_a_dense_solve(spark):
    sf = "/root/testdata/sf0.001"
    got = features.community_count(spark, sf).first()
    train = base.ugraph_split(spark, sf).filter("split = 'train'").collect()
    values = dense_spectrum([(r["src"], r["tgt"]) for r in train])
    laplacian = 2 - 2 * values[: min(51, len(values) - 1)]
    assert got["k"] == int(np.argmax(np.diff(laplacian)[1:]) + 2)


def test_earlier_neighbors_are_strictly_earlier(graph):
    rows = random_edges(8, 120, 5)
    e = graph(rows)
    inc, q = nb.ranked_incidence(e), nb.edge_queries(e)
    full = [(v, n, t, i) for i, (a, b, t) in enumerate(rows) for v, n in ((a, b), (b, a))]
    want = {}
    for r in q.collect():
        past = sorted(((t, i, n) for v, n, t, i in full if v == r["node"] and t < r["t"]), reverse=True)
        want[r["qid"]] = [(i, n) for t, i, n in past]
    got = {}
    for r in nb.recent_neighbors(inc, q, 4).collect():
        got.setdefault(r["qid"], {})[r["slot"]] = (r["eid"], r["nbr"])
    for qid, past in want.items():
        assert got.get(qid, {}) == dict(enumerate(past[:4]))
    everything = {}
    for r in nb.earlier_neighbors(inc, q).collect():
        everything.setdefault(r["qid"], set()).add((r["eid"], r["nbr"]))
    assert everything == {k: set(v) for k, v in want.items() if v}


def test_excluding_reads_older_blocks(graph):
    rows = [(0, 1, t) for t in range(40)] + [(1, 2, 0), (1, 3, 1)]
    rows = [(a, b, t + 1) for a, b, t in rows]
    e = graph(rows)
    roots = e.filter("src = 0 AND t = 40").select(F.lit(7).cast("bigint").alias("root"), F.col("src").alias("node"), "t")
    got = nb.layered_neighbors(e, roots, 2, 2).collect()
    assert {(r["layer"], r["nbr"]) for r in got} == {(1, 1), (2, 2), (2, 3)}


def test_layers_of_long_and_skipped_histories(graph, monkeypatch):
    """Packed blocks next to brute force: a hub, equal times, and ends that mostly meet one node."""
    rng = np.random.default_rng(6)
    rows = [(0, int(b), int(i // 3)) for i, b in enumerate(rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 3], 400))]
    rows = sorted([*rows, *((4, 1, t) for t in (0, 1, 60, 61)), *random_edges(6, 90, 4)], key=lambda r: r[2])
    e = graph(rows)
    full = [(v, n, t, i) for i, (a, b, t) in enumerate(rows) for v, n in ((a, b), (b, a))]

    def recent(node, t, skip):
        past = sorted(((s, i, n) for v, n, s, i in full if v == node and s < t and n not in skip), reverse=True)
        return [(node, n, s, i) for s, i, n in past[:3]]

    roots = nb.edge_queries(e).withColumnRenamed("qid", "root").filter("root % 7 = 0")
    want = []
    for r in roots.collect():
        one = recent(r["node"], r["t"], ())
        want += [(r["root"], 1, *x) for x in one]
        want += [(r["root"], 2, *x) for v in {x[1] for x in one} for x in recent(v, r["t"], (r["node"],))]
    for rows_in_task in (2_000_000, 50):
        monkeypatch.setattr(nb.recent_excluding, "__defaults__", (rows_in_task,))
        got = [tuple(r) for r in nb.layered_neighbors(e, roots, 3, 2).collect()]
        assert sorted(got) == sorted(want)


def test_link_heuristics(graph):
    rows = random_edges(12, 40, 9)
    e = graph(rows)
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    pairs = list(itertools.combinations(range(12), 2))
    links = e.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id bigint, u bigint, v bigint")
    for r in sg.link_heuristics(links, gs.symmetric_adjacency(e)).collect():
        both = near.get(r["u"], set()) & near.get(r["v"], set())
        assert r["common"] == len(both)
        assert r["adamic_adar"] == pytest.approx(sum(1 / np.log(len(near[w])) for w in both if len(near[w]) > 1))


def test_double_radius_labels(graph):
    e = graph([(0, 1, 0), (0, 2, 0), (1, 2, 0), (2, 3, 0), (0, 4, 0)])
    links = e.sparkSession.createDataFrame([(0, 0, 1)], "id bigint, u bigint, v bigint")
    adj = gs.symmetric_adjacency(e)
    nodes = sg.enclosing_nodes(links, adj, 2)
    got = {r["node"]: r["label"] for r in sg.double_radius_labels(links, nodes, sg.induced_edges(links, nodes, adj)).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 5, 4: 0}


def test_line_graph_matches_pairs(graph):
    e = graph(TRI2).withColumn("id", F.lit(0).cast("bigint")).select("id", "src", "tgt", "edge_pos")
    nodes = e.select("id", F.explode(F.array("src", "tgt")).alias("node")).distinct()
    pairs = sg.line_graph_pairs(e, nodes, 10).groupBy("edge_pos").count()
    want = {r["edge_pos"]: r["count"] for r in pairs.collect()}
    assert {r["edge_pos"]: r["adjacent"] for r in sg.line_graph(e).collect()} == want
    star = graph(STAR).withColumn("id", F.lit(0).cast("bigint"))
    assert {r["adjacent"] for r in sg.line_graph(star).collect()} == {8}
    with pytest.raises(ValueError):
        sg.line_graph_pairs(e, nodes, 3)


def test_proximity_matches_inverse(graph):
    rows = random_edges(9, 30, 2)
    e = graph(rows).withColumn("snapshot_id", F.lit(0))
    w = np.zeros((9, 9))
    for a, b, _ in rows:
        w[a, b] += 1
    r = w.sum(1)
    inv = np.where(r > 0, 1 / np.sqrt(np.maximum(r, 1)), 0)
    full = 0.15 * np.linalg.inv(np.eye(9) - 0.85 * (inv[:, None] * w * inv[None, :]))
    np.fill_diagonal(full, 0)
    full = full / np.where(full.sum(1, keepdims=True) > 0, full.sum(1, keepdims=True), 1)
    roots = e.select("snapshot_id", F.explode(F.array("src", "tgt")).alias("root")).distinct()
    got = np.zeros((9, 9))
    for x in px.proximity(px.directed_weights(e), roots).collect():
        got[x["root"], x["node"]] = x["p"]
    assert np.abs(got - full).max() < 1e-3


def test_walks_follow_edges(graph):
    rows = random_edges(15, 50, 4)
    e = graph(rows)
    links = {(a, b) for a, b, _ in rows} | {(b, a) for a, b, _ in rows}
    table, deg = wk.indexed_neighbors(gs.symmetric_adjacency(e))
    start = wk.walkers(deg, 3)
    for df in (wk.random_walks(start, table, deg, 6, 0.0, 1), wk.biased_walks(start, table, deg, 5, 0.25, 4.0, 1)):
        got = df.collect()
        assert len(got) == 3 * deg.count()
        assert all((a, b) in links for r in got for a, b in zip(r["path"], r["path"][1:]))


def test_colors_split_by_degree(graph):
    c = {r["node"]: r["color"] for r in px.node_colors(gs.symmetric_adjacency(graph(PATH5)), 2).collect()}
    assert c[1] == c[5] and c[2] == c[4] and len(set(c.values())) == 3
