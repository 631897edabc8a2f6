"""Subgraph, proximity, walk and propagation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.detection import rounded
from catalog.features import ADJ, GADJ, INC
from catalog.injection import N2, NN, num_nodes, snaps, unseen_sql
from catalog.registry import register
from catalog.sql import BIP, UG, UG_S, pick, u01
from tgraph.functions import scores as sc
from tgraph.operators import graphstats as gs
from tgraph.operators import inject as ij
from tgraph.operators import neighbors as nb
from tgraph.operators import propagate as pg
from tgraph.operators import proximity as px
from tgraph.operators import subgraph as sg
from tgraph.operators import walks as wk
from tgraph.operators.ordering import group_position
from tgraph.plans import base

QUERIES, ORACLE, query = register()

ON = ("snapshot_id",)


def snap_links(spark, sf):
    e = snaps(spark, sf)
    links = e.select(F.col("edge_pos").alias("id"), "snapshot_id", F.col("src").alias("u"), F.col("tgt").alias("v"))
    return e, links, gs.symmetric_adjacency(e, ON)


LINKS = ADJ + """,
li AS (SELECT edge_pos AS id, snapshot_id, src AS u, tgt AS v FROM sn),
en AS (SELECT id, snapshot_id, u AS node, 0 AS hop FROM li UNION SELECT id, snapshot_id, v, 0 FROM li),
nd AS (SELECT id, snapshot_id, node, min(hop) AS hop FROM (SELECT * FROM en UNION SELECT en.id, en.snapshot_id, nbr, 1 FROM en JOIN adj USING (snapshot_id, node)) GROUP BY 1, 2, 3)"""


@query("enclosing_subgraph", f"""
WITH {LINKS},
ie AS (SELECT a.id, a.node, adj.nbr FROM nd a JOIN adj USING (snapshot_id, node) JOIN nd b ON b.id = a.id AND b.node = adj.nbr),
ke AS (SELECT ie.* FROM ie JOIN li ON li.id = ie.id WHERE NOT (ie.node = u AND ie.nbr = v) AND NOT (ie.node = v AND ie.nbr = u)),
ec AS (SELECT id, count(*) // 2 AS edges FROM ke GROUP BY 1)
SELECT id, count(*) AS nodes, max(hop) AS hops, CAST(sum(node) AS BIGINT) AS ids, coalesce(any_value(edges), 0) AS edges FROM nd LEFT JOIN ec USING (id) GROUP BY 1""")
def enclosing_subgraph(spark, sf):
    _, links, adj = snap_links(spark, sf)
    nodes = sg.enclosing_nodes(links, adj, 1, on=ON)
    inner = sg.induced_edges(links, nodes, adj, ON)
    edges = inner.groupBy("id").agg((F.count("*") / 2).cast("bigint").alias("edges"))
    sizes = nodes.groupBy("id").agg(F.count("*").alias("nodes"), F.max("hop").alias("hops"), F.sum("node").alias("ids"))
    return sizes.join(edges, "id", "left").na.fill(0, ["edges"])


@query("drnl", f"""
WITH RECURSIVE {LINKS},
ie AS (SELECT a.id, a.node, adj.nbr FROM nd a JOIN adj ON adj.snapshot_id = a.snapshot_id AND adj.node = a.node JOIN nd b ON b.id = a.id AND b.node = adj.nbr JOIN li ON li.id = a.id
       WHERE NOT (a.node = u AND adj.nbr = v) AND NOT (a.node = v AND adj.nbr = u)),
r0 AS (SELECT id, u AS node, 0 AS d FROM li UNION SELECT r.id, nbr, d + 1 FROM r0 r JOIN ie ON ie.id = r.id AND ie.node = r.node JOIN li ON li.id = r.id WHERE nbr <> v AND d < 12),
r1 AS (SELECT id, v AS node, 0 AS d FROM li UNION SELECT r.id, nbr, d + 1 FROM r1 r JOIN ie ON ie.id = r.id AND ie.node = r.node JOIN li ON li.id = r.id WHERE nbr <> u AND d < 12),
m0 AS (SELECT id, node, min(d) AS d0 FROM r0 GROUP BY 1, 2), m1 AS (SELECT id, node, min(d) AS d1 FROM r1 GROUP BY 1, 2),
lb AS (SELECT nd.id, nd.node, CASE WHEN nd.node = u OR nd.node = v THEN 1 WHEN d0 IS NULL OR d1 IS NULL THEN 0
         ELSE 1 + least(d0, d1) + ((d0 + d1) // 2) * ((d0 + d1) // 2 + (d0 + d1) % 2 - 1) END AS label
       FROM nd JOIN li ON li.id = nd.id LEFT JOIN m0 ON m0.id = nd.id AND m0.node = nd.node LEFT JOIN m1 ON m1.id = nd.id AND m1.node = nd.node)
SELECT id, CAST(label AS INTEGER) AS label, count(*) AS nodes, CAST(sum(node) AS BIGINT) AS ids FROM lb GROUP BY 1, 2""")
def drnl(spark, sf):
    _, links, adj = snap_links(spark, sf)
    nodes = sg.enclosing_nodes(links, adj, 1, on=ON)
    labels = sg.double_radius_labels(links, nodes, sg.induced_edges(links, nodes, adj, ON))
    return labels.groupBy("id", "label").agg(F.count("*").alias("nodes"), F.sum("node").alias("ids"))


@query("capped_subgraph", f"""
WITH {LINKS}, h1 AS (SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY {u01('cap', 'id', 'node')}, node) AS k FROM nd WHERE hop = 1)
SELECT id, count(*) AS nodes, CAST(sum(node) AS BIGINT) AS ids FROM (SELECT id, node FROM en UNION ALL SELECT id, node FROM h1 WHERE k <= 4) GROUP BY 1""")
def capped_subgraph(spark, sf):
    _, links, adj = snap_links(spark, sf)
    nodes = sg.enclosing_nodes(links, adj, 1, 4, "cap", ON)
    return nodes.groupBy("id").agg(F.count("*").alias("nodes"), F.sum("node").alias("ids"))


@query("pooling_size", f"""
WITH {LINKS}, s AS (SELECT id, count(*) AS n FROM nd GROUP BY 1)
SELECT greatest(10.0::DOUBLE, ceil(quantile_cont(n, 0.6))) AS size FROM s""")
def pooling_size(spark, sf):
    _, links, adj = snap_links(spark, sf)
    return sg.subgraph_size(sg.enclosing_nodes(links, adj, 1, on=ON))


EGO = LINKS + f""",
sd AS (SELECT id, snapshot_id, u, v, 0 AS side, u AS root FROM li UNION ALL SELECT id, snapshot_id, u, v, 1, v FROM li),
bl AS (SELECT DISTINCT id, u, v, side, node FROM (SELECT id, u, v, side, root AS node FROM sd UNION ALL SELECT sd.id, u, v, side, nbr FROM sd JOIN adj ON adj.snapshot_id = sd.snapshot_id AND adj.node = sd.root)),
kp AS (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY CASE WHEN node = u OR node = v THEN -1.0::DOUBLE ELSE {u01('ego', 'id', 'side', 'node')} END, node) AS k FROM bl),
eg AS (SELECT DISTINCT id, node FROM kp WHERE k <= 6 OR node = u OR node = v),
pe AS (SELECT li.id, s.src, s.tgt, s.edge_pos FROM li JOIN sn s ON s.snapshot_id = li.snapshot_id JOIN eg a ON a.id = li.id AND a.node = s.src JOIN eg b ON b.id = li.id AND b.node = s.tgt),
ch AS (SELECT id, src, tgt, edge_pos FROM (SELECT *, row_number() OVER (PARTITION BY id, src, tgt ORDER BY {u01('par', 'id', 'edge_pos')}, edge_pos) AS rn FROM pe) WHERE rn = 1),
se AS (SELECT ch.id, src, tgt, CASE WHEN src = u AND tgt = v THEN ch.id ELSE edge_pos END AS edge_pos FROM ch JOIN li ON li.id = ch.id),
sx AS (SELECT id, edge_pos, src AS node FROM se UNION ALL SELECT id, edge_pos, tgt FROM se)"""


def ego(spark, sf):
    e, links, adj = snap_links(spark, sf)
    nodes = sg.ego_union(links, adj, 1, 6, "ego", ON)
    edges = e.select("snapshot_id", "src", "tgt", "edge_pos")
    return links, nodes, sg.subgraph_edges(links, nodes, edges, "par", ON)


@query("ego_subgraph", f"WITH {EGO} SELECT id, src, tgt, CAST(edge_pos AS BIGINT) AS edge_pos FROM se")
def ego_subgraph(spark, sf):
    return ego(spark, sf)[2]


@query("subgraph_order", f"""
WITH {EGO}, f AS (SELECT id, node, min(edge_pos) AS first_edge FROM sx GROUP BY 1, 2)
SELECT id, node, CAST(first_edge AS BIGINT) AS first_edge, row_number() OVER (PARTITION BY id ORDER BY first_edge, node) - 1 AS ord FROM f""")
def subgraph_order(spark, sf):
    return sg.node_order(ego(spark, sf)[2])


@query("subgraph_index", f"WITH {EGO} SELECT id, node, row_number() OVER (PARTITION BY id ORDER BY node) - 1 AS idx FROM eg")
def subgraph_index(spark, sf):
    return sg.batch_index(ego(spark, sf)[1])


@query("line_graph", f"""
WITH {EGO}, p AS (SELECT DISTINCT a.id, a.edge_pos, b.edge_pos AS other FROM sx a JOIN sx b ON a.id = b.id AND a.node = b.node)
SELECT id, CAST(edge_pos AS BIGINT) AS edge_pos, count(*) AS adjacent, round(1.0::DOUBLE / count(*), 9) AS weight FROM p GROUP BY 1, 2""")
def line_graph(spark, sf):
    return rounded(sg.line_graph(ego(spark, sf)[2]))


@query("line_graph_pairs", f"""
WITH {EGO} SELECT id, CAST(a.edge_pos AS BIGINT) AS edge_pos, CAST(b.edge_pos AS BIGINT) AS other FROM sx a JOIN sx b USING (id, node) GROUP BY 1, 2, 3""")
def line_graph_pairs(spark, sf):
    _, nodes, edges = ego(spark, sf)
    return sg.line_graph_pairs(edges, nodes, 12)


HEUR = """
dg AS (SELECT node, count(*) AS d FROM adj GROUP BY 1),
cm AS (SELECT li.id, count(*) AS common, sum(CASE WHEN d > 1 THEN 1.0::DOUBLE / ln(d) ELSE 0 END) AS aa
       FROM li JOIN adj a ON a.node = li.u JOIN adj b ON b.node = li.v AND b.nbr = a.nbr JOIN dg ON dg.node = a.nbr GROUP BY 1)"""


@query("common_neighbors", f"""
WITH {UG_S}, sp AS (SELECT DISTINCT src, tgt FROM us WHERE split = 'train'), adj AS (SELECT src AS node, tgt AS nbr FROM sp UNION ALL SELECT tgt, src FROM sp),
li AS (SELECT edge_pos AS id, src AS u, tgt AS v FROM us WHERE split = 'test'), {HEUR}
SELECT id, u, v, coalesce(x.d, 0) AS d_u, coalesce(y.d, 0) AS d_v, coalesce(common, 0) AS common, round(coalesce(aa, 0), 9) AS adamic_adar
FROM li LEFT JOIN cm USING (id) LEFT JOIN dg x ON x.node = u LEFT JOIN dg y ON y.node = v""")
def common_neighbors(spark, sf):
    e = base.ugraph_split(spark, sf)
    adj = gs.symmetric_adjacency(e.filter(F.col("split") == "train"))
    links = e.filter(F.col("split") == "test").select(
        F.col("edge_pos").alias("id"), F.col("src").alias("u"), F.col("tgt").alias("v")
    )
    return rounded(sg.link_heuristics(links, adj))


@query("hop_choice", f"""
WITH {UG_S}, {NN}, {unseen_sql('hc', N2)}, sp AS (SELECT DISTINCT src, tgt FROM us WHERE split = 'train'), adj AS (SELECT src AS node, tgt AS nbr FROM sp UNION ALL SELECT tgt, src FROM sp),
li AS (SELECT edge_pos AS id, src AS u, tgt AS v, 1 AS label FROM us WHERE split = 'val' UNION ALL SELECT -1 - slot, u, v, 0 FROM w), {HEUR},
s AS (SELECT label, coalesce(common, 0)::DOUBLE AS cn, round(coalesce(aa, 0), 9) AS aa FROM li LEFT JOIN cm USING (id)),
r AS (SELECT label, rank() OVER (ORDER BY cn) + (count(*) OVER (PARTITION BY cn) - 1) / 2.0::DOUBLE AS rc, rank() OVER (ORDER BY aa) + (count(*) OVER (PARTITION BY aa) - 1) / 2.0::DOUBLE AS ra FROM s),
t AS (SELECT sum(label) AS p, sum(1 - label) AS n, sum(rc * label) AS c, sum(ra * label) AS a FROM r)
SELECT round((c - p * (p + 1) / 2.0::DOUBLE) / (p * n), 9) AS auc_common, round((a - p * (p + 1) / 2.0::DOUBLE) / (p * n), 9) AS auc_adamic_adar,
       CAST(CASE WHEN p * n > 0 AND (a - c) >= 0 THEN 2 ELSE 1 END AS INTEGER) AS hops FROM t""")
def hop_choice(spark, sf):
    e = base.ugraph_split(spark, sf)
    adj = gs.symmetric_adjacency(e.filter(F.col("split") == "train"))
    pos = e.filter(F.col("split") == "val").select(
        F.col("edge_pos").alias("id"), F.col("src").alias("u"), F.col("tgt").alias("v"), F.lit(1).alias("label")
    )
    neg = ij.uniform_unseen(e, num_nodes(e), e.count() // 50, "hc").select(
        (F.lit(-1) - F.col("slot")).alias("id"), F.col("src").alias("u"), F.col("tgt").alias("v"), F.lit(0).alias("label")
    )
    scored = sg.link_heuristics(pos.unionByName(neg), adj)
    h, cn, aa = sg.choose_hops(scored.withColumn("adamic_adar", F.round("adamic_adar", 9)))
    return rounded(e.limit(1).select(F.lit(cn).cast("double").alias("auc_common"), F.lit(aa).cast("double").alias("auc_adamic_adar"), F.lit(h).alias("hops")))


def ppr_sql(terms):
    steps = [
        "dw AS (SELECT snapshot_id, src AS node, tgt AS nbr, count(*)::DOUBLE AS w FROM sn GROUP BY 1, 2, 3)",
        "ro AS (SELECT snapshot_id, node, sum(w) AS r FROM dw GROUP BY 1, 2)",
        "nw AS (SELECT dw.snapshot_id, dw.node, nbr, w / sqrt(a.r * b.r) AS w FROM dw JOIN ro a ON a.snapshot_id = dw.snapshot_id AND a.node = dw.node JOIN ro b ON b.snapshot_id = dw.snapshot_id AND b.node = nbr)",
        "k0 AS (SELECT DISTINCT snapshot_id, node AS root, node, 0.15::DOUBLE AS m FROM adj)",
    ]
    steps.append(
        "ks AS (SELECT 0 AS n, * FROM k0 UNION ALL SELECT n + 1, k.snapshot_id, root, nbr AS node, sum(m * w) * 0.85::DOUBLE AS m"
        f" FROM ks k JOIN nw ON nw.snapshot_id = k.snapshot_id AND nw.node = k.node WHERE n < {terms} GROUP BY 1, 2, 3, 4)"
    )
    steps.append("ms AS (SELECT snapshot_id, root, node, sum(m) AS m FROM ks WHERE n > 0 AND root <> node GROUP BY 1, 2, 3)")
    steps.append("pr AS (SELECT snapshot_id, root, node, m / sum(m) OVER (PARTITION BY snapshot_id, root) AS p FROM ms)")
    return ",\n".join(steps)


def ppr(spark, sf):
    e = snaps(spark, sf)
    roots = e.select("snapshot_id", F.explode(F.array("src", "tgt")).alias("root")).distinct()
    return e, px.proximity(px.directed_weights(e), roots)


# 0.85^TERMS is far below what is rounded away
TERMS = 180


@query("ppr", f"WITH RECURSIVE {ADJ}, {ppr_sql(TERMS)} SELECT snapshot_id, root, node, round(p, 8) AS p FROM pr")
def ppr_rows(spark, sf):
    return rounded(ppr(spark, sf)[1], 8)


CONTEXT = f"""
WITH RECURSIVE {ADJ}, {ppr_sql(TERMS)},
vw AS (SELECT edge_pos, snapshot_id - o AS s, o AS lookback, src, tgt FROM sn, range(0, 2) r(o) WHERE snapshot_id >= 1),
ee AS (SELECT edge_pos, lookback, s, src, tgt, src AS root FROM vw UNION ALL SELECT edge_pos, lookback, s, src, tgt, tgt FROM vw),
ne AS (SELECT edge_pos, lookback, s, ee.src, ee.tgt, pr.node, round(sum(p), 9) AS p FROM ee JOIN pr ON pr.snapshot_id = ee.s AND pr.root = ee.root WHERE pr.node <> ee.src AND pr.node <> ee.tgt GROUP BY 1, 2, 3, 4, 5, 6),
tp AS (SELECT edge_pos, lookback, s, node, row_number() OVER (PARTITION BY edge_pos, lookback ORDER BY p DESC, node) AS rank FROM ne),
mb AS (SELECT edge_pos, lookback, s, root AS node, 0 AS rank FROM ee UNION ALL SELECT edge_pos, lookback, s, node, rank FROM tp WHERE rank <= 3),
bf(snapshot_id, root, node, d) USING KEY (snapshot_id, root, node) AS (
  SELECT DISTINCT snapshot_id, node, node, 0 FROM adj
  UNION SELECT DISTINCT b.snapshot_id, b.root, a.nbr, b.d + 1 FROM bf b JOIN adj a ON a.snapshot_id = b.snapshot_id AND a.node = b.node
    LEFT JOIN recurring.bf r ON r.snapshot_id = b.snapshot_id AND r.root = b.root AND r.node = a.nbr WHERE r.d IS NULL),
bm AS (SELECT snapshot_id, root, node, d FROM bf
       UNION ALL SELECT DISTINCT ee.s, ee.root, ee.root, 0 FROM ee WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.snapshot_id = ee.s AND adj.node = ee.root)),
cx AS (SELECT mb.edge_pos, mb.lookback, rank, mb.node, coalesce(min(d), 99) AS hop FROM mb JOIN ee ON ee.edge_pos = mb.edge_pos AND ee.lookback = mb.lookback LEFT JOIN bm ON bm.snapshot_id = mb.s AND bm.root = ee.root AND bm.node = mb.node GROUP BY 1, 2, 3, 4)
"""


@query("edge_context", CONTEXT + """
SELECT edge_pos, CAST(lookback AS INTEGER) AS lookback, CAST(rank AS BIGINT) AS rank, node, CAST(hop AS INTEGER) AS hop FROM cx""")
def edge_context(spark, sf):
    e, p = ppr(spark, sf)
    return px.edge_context(e, p, 3, 2)


@query("context_arrays", CONTEXT + """
SELECT edge_pos, string_agg(node::VARCHAR, ',' ORDER BY lookback, rank, node) AS nodes, string_agg(hop::VARCHAR, ',' ORDER BY lookback, rank, node) AS hop_ids,
       string_agg(rank::VARCHAR, ',' ORDER BY lookback, rank, node) AS position_ids FROM cx GROUP BY 1""")
def context_arrays(spark, sf):
    a = px.context_arrays(edge_context(spark, sf))
    return a.select("edge_pos", *[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("nodes", "hop_ids", "position_ids")])


@query("node_colors", f"WITH {GADJ} SELECT DISTINCT node, 1::BIGINT AS color FROM adj")
def node_colors(spark, sf):
    return px.node_colors(gs.symmetric_adjacency(base.ugraph(spark, sf)))


IDX = GADJ + """,
ix AS (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY nbr) - 1 AS idx FROM adj),
dg AS (SELECT node, count(*) AS deg FROM adj GROUP BY 1),
w0 AS (SELECT node || '-' || r AS walk, node AS start, node AS tip, node::VARCHAR AS path FROM dg, range(0, 2) q(r))"""


def walk_sql(steps, seed, restart, table="ix", deg="dg", first="w0", tag="w"):
    out = []
    for i in range(1, steps):
        back = u01(seed, "'r'", "walk", str(i))
        at = pick("deg", seed, "'n'", "walk", str(i))
        prev = first if i == 1 else f"{tag}{i - 1}"
        out.append(f"""{tag}{i} AS (SELECT walk, start, nx AS tip, path || ',' || nx AS path FROM (
  SELECT s.*, CASE WHEN g.deg IS NULL THEN tip WHEN {back} < {restart} THEN start ELSE nbr END AS nx
  FROM {prev} s LEFT JOIN {deg} g ON g.node = tip LEFT JOIN {table} x ON x.node = tip AND x.idx = {at}))""")
    return ",\n".join(out)


def walk_rows(df):
    return df.select("walk", "start", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def ug_walkers(spark, sf):
    adj = gs.symmetric_adjacency(base.ugraph(spark, sf))
    table, deg = wk.indexed_neighbors(adj)
    return adj, table, deg, wk.walkers(deg, 2)


@query("walks", f"WITH {IDX}, {walk_sql(8, 'rw', '0.15::DOUBLE')} SELECT walk, start, path FROM w7")
def walks(spark, sf):
    _, table, deg, start = ug_walkers(spark, sf)
    return walk_rows(wk.random_walks(start, table, deg, 8, 0.15, "rw"))


def biased_sql(steps, seed):
    # the null first "prev" is folded into later steps unless each is kept apart
    out = ["b0 AS (SELECT walk, start, NULL::BIGINT AS prev, tip, path FROM w0)"]
    for i in range(1, steps):
        at, acc = pick("deg", seed, "'n'", "walk", str(i), "try"), u01(seed, "'a'", "walk", str(i), "try")
        out.append(f"""c{i} AS MATERIALIZED (SELECT s.walk, try, x.nbr, CASE WHEN s.prev IS NULL THEN 2.0::DOUBLE WHEN x.nbr = s.prev THEN 2.0 WHEN l.node IS NOT NULL THEN 1.0 ELSE 0.5 END AS wt, {acc} * 2.0::DOUBLE AS a
  FROM b{i - 1} s JOIN dg ON dg.node = tip CROSS JOIN range(0, 64) r(try) JOIN ix x ON x.node = tip AND x.idx = {at} LEFT JOIN adj l ON l.node = s.prev AND l.nbr = x.nbr),
n{i} AS (SELECT walk, arg_min(nbr, try) AS nbr FROM c{i} WHERE a < wt GROUP BY 1),
b{i} AS (SELECT walk, start, tip AS prev, nbr AS tip, path || ',' || nbr AS path FROM b{i - 1} JOIN n{i} USING (walk))""")
    return ",\n".join(out)


@query("biased_walks", f"WITH {IDX}, {biased_sql(5, 'bw')} SELECT walk, start, path FROM b4")
def biased_walks(spark, sf):
    _, table, deg, start = ug_walkers(spark, sf)
    return walk_rows(wk.biased_walks(start, table, deg, 5, 0.5, 2.0, "bw"))


@query("refreshed_walks", f"""
WITH {IDX}, {walk_sql(4, 'rw', '0.15::DOUBLE')}, {walk_sql(4, 'rw2', '0.15::DOUBLE', tag='z')},
tc AS (SELECT src AS node FROM ug WHERE edge_pos // 500 = (SELECT max(edge_pos // 500) FROM ug) UNION SELECT tgt FROM ug WHERE edge_pos // 500 = (SELECT max(edge_pos // 500) FROM ug))
SELECT walk, start, path FROM w3 WHERE start NOT IN (SELECT node FROM tc) UNION ALL SELECT walk, start, path FROM z3 WHERE start IN (SELECT node FROM tc)""")
def refreshed_walks(spark, sf):
    _, table, deg, start = ug_walkers(spark, sf)
    e = snaps(spark, sf)
    last = e.agg(F.max("snapshot_id").alias("m")).first()["m"]
    touched = e.filter(F.col("snapshot_id") == last).select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    old = wk.random_walks(start, table, deg, 4, 0.15, "rw")
    again = start.join(touched.select(F.col("node").alias("start")), "start", "left_semi")
    return walk_rows(wk.refresh_walks(old, wk.random_walks(again, table, deg, 4, 0.15, "rw2"), touched))


RESERVOIR = UG_S + f""",
tr AS (SELECT DISTINCT node, nbr FROM (SELECT src AS node, tgt AS nbr FROM us WHERE split = 'train' UNION ALL SELECT tgt, src FROM us WHERE split = 'train')),
ti AS (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY nbr) - 1 AS idx FROM tr), td AS (SELECT node, count(*) AS deg FROM tr GROUP BY 1),
i0 AS (SELECT td.node, slot, nbr, 0 AS n FROM td CROSS JOIN range(0, 6) r(slot) JOIN ti ON ti.node = td.node AND ti.idx = {pick('deg', 'rs', "'init'", 'td.node', 'slot')}),
ar AS (SELECT node, nbr, min(edge_pos) AS ep FROM (SELECT src AS node, tgt AS nbr, edge_pos FROM us WHERE split <> 'train' UNION ALL SELECT tgt, src, edge_pos FROM us WHERE split <> 'train') GROUP BY 1, 2),
fr AS (SELECT ar.node, ar.nbr, coalesce(deg, 0) + row_number() OVER (PARTITION BY ar.node ORDER BY ep, ar.nbr) AS n FROM ar LEFT JOIN tr ON tr.node = ar.node AND tr.nbr = ar.nbr LEFT JOIN td ON td.node = ar.node WHERE tr.node IS NULL),
ht AS (SELECT node, slot, nbr, n FROM fr, range(0, 6) r(slot) WHERE {pick('n', 'rs', "'hit'", 'node', 'n', 'slot')} = n - 1),
rv AS (SELECT node, slot, nbr FROM (SELECT *, row_number() OVER (PARTITION BY node, slot ORDER BY n DESC) AS rn FROM (SELECT * FROM i0 UNION ALL SELECT * FROM ht)) WHERE rn = 1)"""


def reservoir_table(spark, sf):
    e = base.ugraph_split(spark, sf)
    train = F.col("split") == "train"
    return wk.reservoir(e.filter(train), e.filter(~train), 6, "rs")


@query("reservoir", f"WITH {RESERVOIR} SELECT node, CAST(slot AS INTEGER) AS slot, nbr FROM rv")
def reservoir(spark, sf):
    return reservoir_table(spark, sf)


@query("reservoir_walks", f"""
WITH {RESERVOIR}, rx AS (SELECT node, slot AS idx, nbr FROM rv), rd AS (SELECT DISTINCT node, 6 AS deg FROM rv),
v0 AS (SELECT node || '-' || r AS walk, node AS start, node AS tip, node::VARCHAR AS path FROM rd, range(0, 2) q(r)),
{walk_sql(5, 'vw', '0.0', 'rx', 'rd', 'v0', 'v')} SELECT walk, start, path FROM v4""")
def reservoir_walks(spark, sf):
    table = reservoir_table(spark, sf)
    start = wk.walkers(table.select("node").distinct(), 2)
    return walk_rows(wk.reservoir_walks(table, start, 6, 5, 0.0, "vw"))


@query("word2vec")
def word2vec(spark, sf):
    _, table, deg, start = ug_walkers(spark, sf)
    vec = wk.walk_embeddings(wk.random_walks(start, table, deg, 8, 0.0, "w2v"), deg.select("node"), 8)
    return vec.select("node", F.size("vec").alias("size"))


# --- propagation -----------------------------------------------------------


def vectors(spark, sf):
    return base.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")
    )


NORM = GADJ + """,
al AS (SELECT node, nbr, w FROM adj UNION ALL SELECT DISTINCT node, node, 1 FROM adj),
rd AS (SELECT node, sum(w)::DOUBLE AS d FROM al GROUP BY 1),
nw AS (SELECT al.node, nbr, w / sqrt(a.d * b.d) AS w FROM al JOIN rd a ON a.node = al.node JOIN rd b ON b.node = nbr),
x0 AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS b FROM embeddings)"""


def show(df, name="vec"):
    return df.select(
        "node", F.round(F.get(name, F.lit(0)), 6).alias("first"), F.round(F.get(name, F.lit(63)), 6).alias("last")
    )


@query("propagate", f"""
WITH {NORM}, s1 AS (SELECT nw.node, sum(w * a) AS a, sum(w * b) AS b FROM nw JOIN x0 ON x0.node = nbr GROUP BY 1),
x1 AS (SELECT x0.node, coalesce(s1.a, x0.a) AS a, coalesce(s1.b, x0.b) AS b FROM x0 LEFT JOIN s1 ON s1.node = x0.node),
s2 AS (SELECT nw.node, sum(w * a) AS a, sum(w * b) AS b FROM nw JOIN x1 ON x1.node = nbr GROUP BY 1)
SELECT x1.node, round(coalesce(s2.a, x1.a), 6) AS first, round(coalesce(s2.b, x1.b), 6) AS last FROM x1 LEFT JOIN s2 ON s2.node = x1.node""")
def propagate(spark, sf):
    adj = gs.symmetric_adjacency(base.ugraph(spark, sf))
    w = gs.normalized_adjacency(adj, "sym", self_loops=True)
    return show(pg.propagate(vectors(spark, sf), w, 64, 2))


@query("mean_neighbors", f"""
WITH {NORM} SELECT adj.node, round(avg(a), 6) AS first, round(avg(b), 6) AS last FROM adj JOIN x0 ON x0.node = nbr GROUP BY 1""")
def mean_neighbors(spark, sf):
    return show(pg.mean_neighbors(vectors(spark, sf), gs.symmetric_adjacency(base.ugraph(spark, sf)), 64))


@query("scatter", f"""
WITH {BIP}, m AS (SELECT src, max(disc) AS mx, sum(disc) AS total, avg(disc) AS mean FROM bip GROUP BY 1), e AS (SELECT edge_pos, bip.src, total, mean, exp(disc - mx) AS e FROM bip JOIN m ON m.src = bip.src)
SELECT edge_pos, src, round(total, 6) AS total, round(mean, 8) AS mean, round(e / sum(e) OVER (PARTITION BY src), 8) AS softmax FROM e""")
def scatter(spark, sf):
    s = pg.scatter(base.bip(spark, sf).select("edge_pos", "src", "disc"), "src", "disc")
    return s.select("edge_pos", "src", F.round("total", 6).alias("total"), F.round("mean", 8).alias("mean"), F.round("softmax", 8).alias("softmax"))


@query("time_encode", f"""
WITH {UG} SELECT edge_pos, round(cos(t / 1000000.0::DOUBLE * pow(10.0::DOUBLE, -9)), 6) AS slow, round(cos(t / 1000000.0::DOUBLE * pow(10.0::DOUBLE, -3)), 6) AS mid,
       round(cos(ln(1 + edge_pos) * pow(10.0::DOUBLE, -1.5)), 6) AS log_slow FROM ug""")
def time_encode(spark, sf):
    e = base.ugraph(spark, sf)
    enc = sc.time_encoding(F.col("t") / F.lit(1e6), 10)
    log = sc.time_encoding("edge_pos", 4, 1.5, log=True)
    return e.select(
        "edge_pos", F.round(F.get(enc, F.lit(9)), 6).alias("slow"), F.round(F.get(enc, F.lit(3)), 6).alias("mid"),
        F.round(F.get(log, F.lit(3)), 6).alias("log_slow"),
    )


@query("temporal_mean", f"""
WITH {INC}, j AS (SELECT qid, (q.t - inc.t) / 1000000.0::DOUBLE AS age, row_number() OVER (PARTITION BY qid ORDER BY inc.t DESC, eid DESC, nbr DESC) AS rn FROM q JOIN inc ON q.node = inc.node AND inc.t < q.t)
SELECT qid, round(avg(cos(ln(1 + age))), 6) AS mean_fast, round(sum(cos(ln(1 + age) * pow(10.0::DOUBLE, -1.5))), 6) AS total_slow FROM j WHERE rn <= 5 GROUP BY 1""")
def temporal_mean(spark, sf):
    e = base.ugraph(spark, sf)
    q = nb.edge_queries(e)
    f = pg.temporal_features(nb.recent_neighbors(nb.ranked_incidence(e), q, 5), q, 4)
    return f.select("qid", F.round(F.get("mean", F.lit(0)), 6).alias("mean_fast"), F.round(F.get("total", F.lit(3)), 6).alias("total_slow"))


@query("short_term_attention", """
WITH s AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
l AS (SELECT *, lag(a, 1) OVER (PARTITION BY label ORDER BY pos) AS b, lag(a, 2) OVER (PARTITION BY label ORDER BY pos) AS c FROM s)
SELECT vec_id, round((0.6::DOUBLE * a + 0.3::DOUBLE * coalesce(b, 0) + 0.1::DOUBLE * coalesce(c, 0)) / (0.6::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.1::DOUBLE END), 6) AS first FROM l""")
def short_term_attention(spark, sf):
    s = base.table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    s = group_position(s, ["label"], ["vec_id"], "pos")
    out = pg.short_term_attention(s, "label", "pos", 64, [0.6, 0.3, 0.1])
    return out.select("vec_id", F.round(F.get("short_term", F.lit(0)), 6).alias("first"))
