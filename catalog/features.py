"""Neighbour and graph-statistic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.detection import rounded
from catalog.injection import SNAP, num_nodes, snaps, with_msg
from catalog.registry import register
from catalog.sql import BIP, UG, UG_S, pick, u01
from tgraph.operators import graphstats as gs
from tgraph.operators import neighbors as nb
from tgraph.operators import spectral as sx
from tgraph.plans import base

QUERIES, ORACLE, query = register()


INC = UG + """,
inc AS (SELECT src AS node, tgt AS nbr, t, edge_pos AS eid FROM ug UNION ALL SELECT tgt, src, t, edge_pos FROM ug),
q AS (SELECT edge_pos * 2 AS qid, src AS node, t FROM ug UNION ALL SELECT edge_pos * 2 + 1, tgt, t FROM ug)"""


@query("recent_neighbors", f"""
WITH {INC}, j AS (SELECT qid, q.node, nbr, inc.t AS nbr_t, eid, row_number() OVER (PARTITION BY qid ORDER BY inc.t DESC, eid DESC, nbr DESC) - 1 AS slot
  FROM q JOIN inc ON q.node = inc.node AND inc.t < q.t)
SELECT qid, node, slot, nbr, nbr_t, eid FROM j WHERE slot < 5""")
def recent_neighbors(spark, sf):
    e = base.ugraph(spark, sf)
    return nb.recent_neighbors(nb.ranked_incidence(e), nb.edge_queries(e), 5)


@query("history_size", f"""
WITH {INC} SELECT qid, q.node, q.t, count(inc.eid) AS c FROM q LEFT JOIN inc ON q.node = inc.node AND inc.t < q.t GROUP BY 1, 2, 3""")
def history_size(spark, sf):
    e = base.ugraph(spark, sf)
    return nb.history_size(nb.incidence(e), nb.edge_queries(e))


@query("earlier_neighbors", f"""
WITH {INC}, j AS (SELECT qid, q.node, count(*) AS n, sum(nbr) AS nbrs, max(inc.t) AS last_t FROM q JOIN inc ON q.node = inc.node AND inc.t < q.t GROUP BY 1, 2)
SELECT qid, node, n, CAST(nbrs AS BIGINT) AS nbrs, last_t FROM j""")
def earlier_neighbors(spark, sf):
    e = base.ugraph(spark, sf)
    return nb.history_stats(nb.incidence(e), nb.edge_queries(e)).filter("n > 0")


@query("sampled_neighbors", f"""
WITH {INC}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t, eid, nbr) AS rn FROM inc),
h AS (SELECT qid, q.node, count(*) AS c FROM q JOIN inc ON q.node = inc.node AND inc.t < q.t GROUP BY 1, 2)
SELECT qid, h.node, CAST(draw AS INTEGER) AS draw, nbr, r.t AS nbr_t, eid FROM h, range(1, 4) d(draw) JOIN r ON r.node = h.node AND r.rn = {pick('c', 'un', 'qid', 'draw')} + 1""")
def sampled_neighbors(spark, sf):
    e = base.ugraph(spark, sf)
    return nb.sampled_neighbors(nb.ranked_incidence(e), nb.edge_queries(e), 3, "un")


@query("padded_neighbors", f"""
WITH {INC}, j AS (SELECT qid, nbr, inc.t AS nbr_t, eid, row_number() OVER (PARTITION BY qid ORDER BY inc.t DESC, eid DESC, nbr DESC) - 1 AS slot
  FROM q JOIN inc ON q.node = inc.node AND inc.t < q.t)
SELECT q.qid, q.node, q.t, coalesce(max(nbr) FILTER (slot = 2), 0) AS n1, coalesce(max(nbr) FILTER (slot = 1), 0) AS n2, coalesce(max(nbr) FILTER (slot = 0), 0) AS n3,
       coalesce(max(nbr_t) FILTER (slot = 2), 0) AS t1 FROM q LEFT JOIN j ON j.qid = q.qid AND slot < 3 GROUP BY 1, 2, 3""")
def padded_neighbors(spark, sf):
    e = base.ugraph(spark, sf)
    q = nb.edge_queries(e)
    p = nb.padded(nb.recent_neighbors(nb.ranked_incidence(e), q, 3), q, 3)
    return p.select(
        "qid", "node", "t", *[F.get("neighbors", F.lit(i)).alias(f"n{i + 1}") for i in range(3)],
        F.get("edge_times", F.lit(0)).alias("t1"),
    )


@query("two_layer_neighbors", f"""
WITH {INC}, r1 AS (SELECT qid AS root, 1 AS layer, node, nbr, nbr_t, eid, t FROM (
  SELECT qid, q.node, nbr, inc.t AS nbr_t, eid, q.t, row_number() OVER (PARTITION BY qid ORDER BY inc.t DESC, eid DESC, nbr DESC) AS rn
  FROM q JOIN inc ON q.node = inc.node AND inc.t < q.t) WHERE rn <= 3),
f AS (SELECT DISTINCT root, nbr AS node, t, node AS up FROM r1),
r2 AS (SELECT root, 2 AS layer, node, nbr, nbr_t, eid FROM (
  SELECT root, f.node, inc.nbr, inc.t AS nbr_t, eid, row_number() OVER (PARTITION BY root, f.node ORDER BY inc.t DESC, eid DESC, inc.nbr DESC) AS rn
  FROM f JOIN inc ON f.node = inc.node AND inc.t < f.t AND inc.nbr <> f.up) WHERE rn <= 3)
SELECT root, CAST(layer AS INTEGER) AS layer, count(*) AS n, CAST(sum(node) AS BIGINT) AS nodes, CAST(sum(nbr) AS BIGINT) AS nbrs, CAST(sum(eid) AS BIGINT) AS eids
FROM (SELECT root, layer, node, nbr, eid FROM r1 UNION ALL SELECT root, layer, node, nbr, eid FROM r2) GROUP BY 1, 2""")
def two_layer_neighbors(spark, sf):
    e = base.ugraph(spark, sf)
    roots = nb.edge_queries(e).withColumnRenamed("qid", "root")
    rows = nb.layered_neighbors(e, roots, 3, 2)
    return rows.groupBy("root", "layer").agg(
        F.count("*").alias("n"), F.sum("node").alias("nodes"), F.sum("nbr").alias("nbrs"), F.sum("eid").alias("eids")
    )


@query("split_adjacency", f"""
WITH {UG_S}, x AS (SELECT src AS node, tgt AS nbr, t, edge_pos AS eid, split FROM us UNION ALL SELECT tgt, src, t, edge_pos, split FROM us)
SELECT node, nbr, t, eid, row_number() OVER (PARTITION BY node ORDER BY t, eid, nbr) AS rn FROM x WHERE split IN ('train', 'val')""")
def split_adjacency(spark, sf):
    return nb.sorted_adjacency(base.ugraph_split(spark, sf), ("train", "val"))


@query("node_messages", f"""
WITH {BIP}, x AS (SELECT src AS node, t, qty, disc FROM bip UNION ALL SELECT tgt, t, qty, disc FROM bip)
SELECT node, round(avg(qty), 9) AS m0, round(avg(disc), 9) AS m1, max(t) AS last_t, count(*) AS n FROM x GROUP BY 1""")
def node_messages(spark, sf):
    m = nb.node_messages(with_msg(base.bip(spark, sf)), "msg", 2)
    return m.select(
        "node", F.round(F.get("message", F.lit(0)), 9).alias("m0"), F.round(F.get("message", F.lit(1)), 9).alias("m1"), "last_t", "n"
    )


@query("degree_stats", f"""
WITH {UG_S}, nn AS (SELECT max(greatest(src, tgt)) + 1 AS n FROM us),
d AS (SELECT v, count(*) AS d FROM (SELECT src AS v FROM us WHERE split = 'train' UNION ALL SELECT tgt FROM us WHERE split = 'train') GROUP BY 1)
SELECT round(sum(d) / max(n)::DOUBLE, 9) AS mean_degree, round(sqrt(sum(d * d) / max(n)::DOUBLE - (sum(d) / max(n)::DOUBLE) * (sum(d) / max(n)::DOUBLE)), 9) AS std_degree FROM d, nn""")
def degree_stats(spark, sf):
    e = base.ugraph_split(spark, sf)
    return rounded(gs.degree_stats(e.filter(F.col("split") == "train"), num_nodes(e)))


ADJ = SNAP + """,
sp AS (SELECT DISTINCT snapshot_id, src, tgt FROM sn),
adj AS (SELECT snapshot_id, src AS node, tgt AS nbr FROM sp UNION ALL SELECT snapshot_id, tgt, src FROM sp)"""

GADJ = UG + """,
sp AS (SELECT src, tgt, count(*) AS w FROM ug GROUP BY 1, 2),
adj AS (SELECT src AS node, tgt AS nbr, w FROM sp UNION ALL SELECT tgt, src, w FROM sp)"""


@query("adjacency", f"WITH {GADJ} SELECT node, nbr, w FROM adj")
def adjacency(spark, sf):
    return gs.symmetric_adjacency(base.ugraph(spark, sf))


@query("adj_norm", f"""
WITH {GADJ}, l AS (SELECT node, nbr, w FROM adj UNION ALL SELECT DISTINCT node, node, 1 FROM adj), d AS (SELECT node, sum(w)::DOUBLE AS d FROM l GROUP BY 1),
r AS (SELECT node, sum(w)::DOUBLE AS d FROM adj GROUP BY 1)
SELECT l.node, l.nbr, round(l.w / sqrt(a.d * b.d), 9) AS sym, round(CASE WHEN l.node <> l.nbr THEN l.w / r.d ELSE 0 END, 9) AS by_row
FROM l JOIN d a ON a.node = l.node JOIN d b ON b.node = l.nbr JOIN r ON r.node = l.node""")
def adj_norm(spark, sf):
    adj = gs.symmetric_adjacency(base.ugraph(spark, sf))
    sym = gs.normalized_adjacency(adj, "sym", self_loops=True).withColumnRenamed("w", "sym")
    row = gs.normalized_adjacency(adj, "row").withColumnRenamed("w", "by_row")
    return rounded(sym.join(row, ["node", "nbr"], "left").na.fill(0.0, ["by_row"]))


@query("symmetrized", f"""
WITH {UG}, a AS (SELECT src AS node, tgt AS nbr, count(*) AS w FROM ug GROUP BY 1, 2), b AS (SELECT node, nbr, w FROM a UNION ALL SELECT nbr, node, w FROM a)
SELECT node, nbr, max(w) AS w FROM b GROUP BY 1, 2""")
def symmetrized(spark, sf):
    a = base.ugraph(spark, sf).groupBy(F.col("src").alias("node"), F.col("tgt").alias("nbr")).agg(F.count("*").alias("w"))
    return gs.symmetrize_max(a)


@query("khop", f"""
WITH {ADJ}, b0 AS (SELECT DISTINCT snapshot_id, node AS root, node, 0 AS hops FROM adj),
b1 AS (SELECT DISTINCT snapshot_id, root, node, min(hops) AS hops FROM (SELECT * FROM b0 UNION ALL SELECT b.snapshot_id, root, nbr, 1 FROM b0 b JOIN adj a ON a.snapshot_id = b.snapshot_id AND a.node = b.node) GROUP BY 1, 2, 3),
b2 AS (SELECT DISTINCT snapshot_id, root, node, min(hops) AS hops FROM (SELECT * FROM b1 UNION ALL SELECT b.snapshot_id, root, nbr, 2 FROM b1 b JOIN adj a ON a.snapshot_id = b.snapshot_id AND a.node = b.node AND hops = 1) GROUP BY 1, 2, 3)
SELECT snapshot_id, root, CAST(hops AS INTEGER) AS hops, count(*) AS nodes, CAST(sum(node) AS BIGINT) AS ids FROM b2 GROUP BY 1, 2, 3""")
def khop(spark, sf):
    adj = gs.symmetric_adjacency(snaps(spark, sf), ("snapshot_id",))
    roots = adj.select("snapshot_id", F.col("node").alias("root")).distinct()
    d = gs.hop_distances(adj, roots, 2, ("snapshot_id",))
    return d.groupBy("snapshot_id", "root", "hops").agg(F.count("*").alias("nodes"), F.sum("node").alias("ids"))


@query("diameter_estimate", f"""
WITH RECURSIVE {GADJ}, nn AS (SELECT max(greatest(src, tgt)) + 1 AS n FROM ug),
dr AS (SELECT id, {pick('n', 'di', "'bfs'", 'id')} AS root FROM nn, range(0, 500) r(id)),
b AS (SELECT DISTINCT root, root AS node, 0 AS hops FROM dr UNION SELECT root, nbr, hops + 1 FROM b JOIN adj a ON a.node = b.node WHERE hops < 6),
m AS (SELECT root, node, min(hops) AS h FROM b GROUP BY 1, 2), f AS (SELECT root, max(h) AS far FROM m WHERE h > 0 GROUP BY 1)
SELECT round(quantile_cont(far::DOUBLE, 0.9), 6) AS est_diameter FROM dr JOIN f USING (root)""")
def diameter_estimate(spark, sf):
    e = base.ugraph(spark, sf)
    d = gs.estimate_diameter(gs.symmetric_adjacency(e), num_nodes(e), 500, "di")
    return e.limit(1).select(F.lit(d).alias("est_diameter"))


@query("components", f"""
WITH RECURSIVE {ADJ}, r AS (SELECT DISTINCT snapshot_id, node, node AS label FROM adj UNION SELECT a.snapshot_id, a.nbr, r.label FROM r JOIN adj a ON a.snapshot_id = r.snapshot_id AND a.node = r.node WHERE r.label < a.nbr)
SELECT snapshot_id, node, min(label) AS label FROM r GROUP BY 1, 2""")
def components(spark, sf):
    return gs.components(gs.symmetric_adjacency(snaps(spark, sf), ("snapshot_id",)), ("snapshot_id",))


def lpa_sql(rounds):
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT node, node AS cluster FROM adj)"]
    for i in range(rounds):
        steps.append(f"""v{i} AS MATERIALIZED (SELECT node, cluster, sum(w) AS w FROM (SELECT a.node, cluster, w FROM adj a JOIN l{i} l ON l.node = a.nbr UNION ALL SELECT node, cluster, 1 FROM l{i}) GROUP BY 1, 2),
l{i + 1} AS MATERIALIZED (SELECT node, cluster FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, cluster) AS rn FROM v{i}) WHERE rn = 1)""")
    return ",\n".join(steps)


# after 60 rounds labels are settled, or alternate between two
@query("label_prop", f"WITH {GADJ}, {lpa_sql(61)} SELECT l60.node AS node_id, least(l60.cluster, l61.cluster) AS cluster FROM l60 JOIN l61 ON l61.node = l60.node")
def label_prop(spark, sf):
    return gs.label_propagation(gs.symmetric_adjacency(base.ugraph(spark, sf)))


@query("snapshot_props", f"""
WITH RECURSIVE {ADJ}, dg AS (SELECT snapshot_id, node, count(*) AS d FROM adj GROUP BY 1, 2),
tri AS (SELECT a.snapshot_id, a.src AS a, a.tgt AS b, c.tgt AS c FROM sp a JOIN sp b ON b.snapshot_id = a.snapshot_id AND b.src = a.tgt JOIN sp c ON c.snapshot_id = a.snapshot_id AND c.src = a.src AND c.tgt = b.tgt),
tn AS (SELECT snapshot_id, node, count(*) AS tri FROM (SELECT snapshot_id, a AS node FROM tri UNION ALL SELECT snapshot_id, b FROM tri UNION ALL SELECT snapshot_id, c FROM tri) GROUP BY 1, 2),
ow AS (SELECT dg.snapshot_id, dg.node, d, coalesce(tri, 0) AS tri FROM dg LEFT JOIN tn ON tn.snapshot_id = dg.snapshot_id AND tn.node = dg.node),
mx AS (SELECT adj.snapshot_id, corr(a.d::DOUBLE, b.d::DOUBLE) AS assortativity FROM adj JOIN dg a ON a.snapshot_id = adj.snapshot_id AND a.node = adj.node JOIN dg b ON b.snapshot_id = adj.snapshot_id AND b.node = adj.nbr GROUP BY 1),
r AS (SELECT DISTINCT snapshot_id, node, node AS label FROM adj UNION SELECT a.snapshot_id, a.nbr, r.label FROM r JOIN adj a ON a.snapshot_id = r.snapshot_id AND a.node = r.node WHERE r.label < a.nbr),
cc AS (SELECT snapshot_id, count(DISTINCT label) AS components FROM (SELECT snapshot_id, node, min(label) AS label FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT ow.snapshot_id, count(*) AS num_nodes, CAST(sum(d) / 2 AS BIGINT) AS num_edges, round(sum(d) / (count(*) * (count(*) - 1))::DOUBLE, 8) AS density, round(avg(d), 8) AS average_degree,
       round(avg(CASE WHEN d > 1 THEN tri / (d * (d - 1) / 2.0::DOUBLE) ELSE 0 END), 8) AS clustering,
       round(coalesce(sum(tri)::DOUBLE / nullif(sum(d * (d - 1) / 2.0::DOUBLE), 0), 0), 8) AS transitivity, round(any_value(assortativity), 8) AS assortativity, any_value(components) AS components
FROM ow JOIN mx ON mx.snapshot_id = ow.snapshot_id JOIN cc ON cc.snapshot_id = ow.snapshot_id GROUP BY 1""")
def snapshot_props(spark, sf):
    return rounded(gs.snapshot_properties(snaps(spark, sf)), 8)


def squared_sql(times):
    """Dense Laplacians squared ``times`` times, each scaled by its largest diagonal entry."""
    steps = ["""b0 AS (SELECT c.snapshot_id, c.node, list(CASE WHEN c.node = o.node THEN c.d ELSE -coalesce(w, 0)::DOUBLE END ORDER BY o.node) AS v
FROM dg c JOIN dg o ON o.snapshot_id = c.snapshot_id LEFT JOIN adj ON adj.snapshot_id = c.snapshot_id AND adj.node = c.node AND adj.nbr = o.node GROUP BY 1, 2)"""]
    for i in range(times):
        steps.append(f"""s{i} AS MATERIALIZED (SELECT snapshot_id, max(list_max(v)) AS s FROM b{i} GROUP BY 1),
b{i + 1} AS MATERIALIZED (SELECT a.snapshot_id, a.node, list(list_dot_product(a.v, b.v) / s / s ORDER BY b.node) AS v
FROM b{i} a JOIN b{i} b ON b.snapshot_id = a.snapshot_id JOIN s{i} s ON s.snapshot_id = a.snapshot_id GROUP BY 1, 2)""")
    return ",\n".join(steps)


SQUARED = 16


@query("spectral_change", f"""
WITH {SNAP}, sp AS (SELECT snapshot_id, src, tgt, count(*) AS w FROM sn GROUP BY 1, 2, 3),
adj AS (SELECT snapshot_id, src AS node, tgt AS nbr, w FROM sp UNION ALL SELECT snapshot_id, tgt, src, w FROM sp),
dg AS (SELECT snapshot_id, node, sum(w)::DOUBLE AS d FROM adj GROUP BY 1, 2), {squared_sql(SQUARED)},
x0 AS (SELECT snapshot_id, list({u01('ev', 'snapshot_id', 'node')} + 0.5::DOUBLE ORDER BY node) AS x FROM dg GROUP BY 1),
y AS (SELECT b.snapshot_id, node, list_dot_product(v, x) AS x FROM b{SQUARED} b JOIN x0 ON x0.snapshot_id = b.snapshot_id),
z AS (SELECT snapshot_id, node, x / max(abs(x)) OVER (PARTITION BY snapshot_id) AS x FROM y),
m AS (SELECT snapshot_id, arg_min(x, node) AS m FROM z WHERE round(abs(x), 6) = 1 GROUP BY 1),
e AS (SELECT z.snapshot_id, node, x / m AS x FROM z JOIN m ON m.snapshot_id = z.snapshot_id)
SELECT a.snapshot_id, a.node, round(coalesce(abs(a.x - b.x), 0), 5) AS change FROM e a LEFT JOIN e b ON b.snapshot_id = a.snapshot_id - 1 AND b.node = a.node""")
def spectral_change(spark, sf):
    """The SQL takes the power 2**16 of each dense Laplacian."""
    return rounded(sx.spectral_change(sx.spectral_vectors(snaps(spark, sf), 1e-11, "ev")), 5)


@query("community_count")
def community_count(spark, sf):
    """Number of communities by the eigengap of the training graph."""
    e = base.ugraph_split(spark, sf).filter(F.col("split") == "train")
    adj = gs.symmetric_adjacency(e)
    k = gs.eigengap(adj, max_k=50, seed="eg")
    n = num_nodes(e)
    return e.agg(F.count("*").alias("train_edges")).select(
        "train_edges", F.lit(k).alias("k"), F.lit(n / k).alias("avg_cluster_size")
    )
