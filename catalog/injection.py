"""Anomaly-generation and negative-edge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.sql import BIP, BIP_S, UG, UG_S, permuted, pick, u01
from tgraph.operators import inject as ij
from tgraph.operators import negatives as ng
from tgraph.operators import timeline as tl
from tgraph.operators.sampling import observed_pairs, pair_product, product_sample
from tgraph.plans import base

QUERIES, ORACLE, query = register()


def num_nodes(edges):
    return edges.agg(F.max(F.greatest("src", "tgt")).alias("m")).first()["m"] + 1


def with_msg(edges):
    return edges.withColumn("msg", F.array("qty", "disc", "price"))


RATIOS = {"val": 0.04, "test": 0.05}

# --- grouped injection ----------------------------------------------------

CANDIDATES = {
    "random": lambda s, k: f"""
      SELECT g, i, {pick('n', s, "'u'", 'g', 'i')} AS u, {pick('n', s, "'v'", 'g', 'i')} AS v
      FROM nn, range(0, GROUPS) a(g), range(0, 10) b(i)""",
    "burst": lambda s, k: f"""
      SELECT g, i, {pick('n', s, "'c'", 'g')} AS u, {pick('n', s, "'v'", 'g', 'i')} AS v
      FROM nn, range(0, GROUPS) a(g), range(0, (SELECT k FROM burst)) b(i)""",
    "clique": lambda s, k: f"""
      SELECT g, row_number() OVER (PARTITION BY g ORDER BY a, b) - 1 AS i, u, v FROM (
        SELECT x.g, x.p AS a, y.p AS b, x.node AS u, y.node AS v FROM {s.replace('-', '_')}_n x JOIN {s.replace('-', '_')}_n y ON x.g = y.g AND x.p < y.p)""",
    "path": lambda s, k: f"""
      SELECT x.g, x.p - 1 AS i, x.node AS u, y.node AS v FROM {s.replace('-', '_')}_n x JOIN {s.replace('-', '_')}_n y ON x.g = y.g AND y.p = x.p + 1""",
    "bridge": lambda s, k: f"""
      SELECT g, 0 AS i, x.node AS u, y.node AS v FROM (
        SELECT g, {pick('8', s, "'a'", 'g')} AS ca,
               ({pick('8', s, "'a'", 'g')} + 1 + {pick('7', s, "'b'", 'g')}) % 8 AS cb FROM range(0, GROUPS) a(g)) q
      JOIN comm x ON x.c = ca AND x.m = {pick('x.size', s, "'u'", 'g')} + 1
      JOIN comm y ON y.c = cb AND y.m = {pick('y.size', s, "'v'", 'g')} + 1""",
}


def chain(kind, split, ratio, observed, offset, k, groups):
    s = f"s-{split}"
    t = f"s_{split}"
    nodes = ""
    if kind in ("clique", "path"):
        nodes = f"""
{t}_n AS (SELECT g, node, p FROM (
   SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY first) AS p FROM (
     SELECT g, node, min(i) AS first FROM (
       SELECT g, i, {pick('n', s, "'n'", 'g', 'i')} AS node FROM nn, range(0, {groups}) a(g), range(1, {4 * k + 9}) b(i)) GROUP BY 1, 2))
   WHERE p <= {k}),"""
    cand = CANDIDATES[kind](s, k).replace("GROUPS", str(groups))
    start = u01(s, "'start'", "g")
    when = u01(s, "'t'", "g", "i")
    return nodes + f"""
{t}_x AS (SELECT CAST(floor(count(*) * {ratio}::DOUBLE) AS BIGINT) AS target, CAST(min(t) AS DOUBLE) AS lo, CAST(max(t) AS DOUBLE) AS hi FROM us WHERE split = '{split}'),
{t}_c AS ({cand}),
{t}_f AS (SELECT g, i, u, v FROM (
   SELECT c.*, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY g, i) AS rn FROM {t}_c c
   LEFT JOIN {observed} o ON o.lo = least(u, v) AND o.hi = greatest(u, v) WHERE u <> v AND o.lo IS NULL) WHERE rn = 1),
{t}_s AS (SELECT g, count(*) AS n FROM {t}_f GROUP BY 1),
{t}_k AS (SELECT g, gid FROM (SELECT g, n, sum(n) OVER (ORDER BY g) AS upto, row_number() OVER (ORDER BY g) AS gid FROM {t}_s), {t}_x WHERE upto - n < target),
{t}_t AS (SELECT g, i, u, v, gid, lo + {start} * (greatest(lo, hi - (hi - lo) * 0.5::DOUBLE) - lo) + {when} * ((hi - lo) * 0.5::DOUBLE) AS d
   FROM {t}_f JOIN {t}_k USING (g), {t}_x),
{t}_p AS (SELECT a.u AS src, a.v AS tgt, b.d AS t, '{split}' AS split, a.gid + {offset} AS group_id FROM
   (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS r FROM {t}_t) a JOIN
   (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) AS r FROM {t}_t) b ON a.g = b.g AND a.r = b.r)"""


def injected_sql(kind, k=0, groups=600):
    return f"""
WITH {UG_S}, nn AS (SELECT max(greatest(src, tgt)) + 1 AS n FROM us),
deg AS (SELECT avg(d) AS m, sqrt(avg(d * d) - avg(d) * avg(d)) AS sd FROM (
  SELECT coalesce(d, 0)::DOUBLE AS d FROM nn, range(0, n) r(v) LEFT JOIN (
    SELECT v, count(*) AS d FROM (SELECT src AS v FROM us WHERE split = 'train' UNION ALL SELECT tgt FROM us WHERE split = 'train') GROUP BY 1) USING (v))),
burst AS (SELECT greatest(10, least(100, CAST(floor(m + 3 * sd) AS BIGINT))) AS k FROM deg),
comm AS (SELECT node, node % 8 AS c, row_number() OVER (PARTITION BY node % 8 ORDER BY node) AS m, count(*) OVER (PARTITION BY node % 8) AS size
         FROM (SELECT src AS node FROM us UNION SELECT tgt FROM us)),
o1 AS (SELECT DISTINCT src AS lo, tgt AS hi FROM us),
{chain(kind, 'val', RATIOS['val'], 'o1', '0', k, groups)},
o2 AS (SELECT lo, hi FROM o1 UNION ALL SELECT least(src, tgt), greatest(src, tgt) FROM s_val_p),
{chain(kind, 'test', RATIOS['test'], 'o2', '(SELECT max(group_id) FROM s_val_p)', k, groups)}
SELECT src, tgt, round(t, 0) AS t, split, CAST(group_id AS BIGINT) AS group_id FROM (SELECT * FROM s_val_p UNION ALL SELECT * FROM s_test_p)"""


def communities(spark, sf):
    """A node partition given as a table; here by id."""
    e = base.ugraph(spark, sf)
    nodes = e.select(F.explode(F.array("src", "tgt")).alias("node_id")).distinct()
    return nodes.withColumn("cluster", F.col("node_id") % 8)


def injected(spark, sf, kind):
    from tgraph.operators.graphstats import degree_stats

    e = base.ugraph_split(spark, sf)
    n = num_nodes(e)
    stats = {"avg_cluster_size": 16.0, "est_diameter": 5.0}
    if kind == "burst":
        row = degree_stats(e.filter(F.col("split") == "train"), n).first()
        stats.update(mean_degree=row["mean_degree"], std_degree=row["std_degree"])
    comm = communities(spark, sf) if kind == "bridge" else None
    out, _ = ij.inject(e, kind, RATIOS, n, stats, "medium", comm, "s")
    return out.select("src", "tgt", F.round("t", 0).alias("t"), "split", "group_id")


for _kind, _k in (("random", 0), ("burst", 0), ("clique", 8), ("path", 7), ("bridge", 0)):
    query(f"inject_{_kind}", injected_sql(_kind, _k))(
        lambda spark, sf, kind=_kind: injected(spark, sf, kind)
    )


@query("inject_merged")
def inject_merged(spark, sf):
    """Injection into the interaction log with messages, then the summary."""
    e = with_msg(base.bip_split(spark, sf)).select("src", "tgt", "t", "edge_pos", "split", "label", "msg")
    new, _ = ij.inject(e, "random", {"val": 0.05, "test": 0.05}, num_nodes(e), seed="m", msg_size=3)
    merged = ij.merge_injected(e, new)
    return ij.injection_summary(merged).withColumn("ratio", F.round("ratio", 9))


@query("last_message", f"""
WITH {BIP_S} SELECT src, qty, round(price, 2) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY t DESC, edge_pos DESC) AS rn FROM bs) WHERE rn = 1""")
def last_message(spark, sf):
    m = ij.last_messages(with_msg(base.bip_split(spark, sf)))
    return m.select("src", F.get("msg", F.lit(0)).alias("qty"), F.round(F.get("msg", F.lit(2)), 2).alias("price"))


# --- structural / temporal / contextual -----------------------------------

TEST_ROWS = f"""{BIP_S}, te AS (SELECT * FROM bs WHERE split = 'test'),
tn AS (SELECT CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) AS m, min(t) AS a, max(t) AS b FROM te)"""


@query("inject_structural", f"""
WITH {TEST_ROWS},
s AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT src FROM te)),
g AS (SELECT tgt, row_number() OVER (ORDER BY tgt) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT tgt FROM te)),
{permuted('pm', '(SELECT (SELECT count(*) FROM s) * (SELECT count(*) FROM g))', 'x-structural', '400 * (SELECT m FROM tn)')},
c AS (SELECT cand, s.src AS u, g.tgt AS v FROM pm JOIN s ON s.i = code // (SELECT count(*) FROM g) JOIN g ON g.i = code % (SELECT count(*) FROM g)),
f AS (SELECT u, v, min(cand) AS cand FROM c LEFT JOIN (SELECT DISTINCT src, tgt FROM bs) o ON o.src = u AND o.tgt = v
      WHERE u <> v AND o.src IS NULL GROUP BY 1, 2),
k AS (SELECT u, v FROM (SELECT *, row_number() OVER (ORDER BY cand) AS rn FROM f), tn WHERE rn <= m),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_pos) AS rn FROM te) WHERE rn = 1)
SELECT u AS src, v AS tgt, r.t, r.qty, 'structural' AS kind FROM k JOIN r ON k.u = r.src""")
def inject_structural(spark, sf):
    return rows_of(spark, sf, "structural")


def rows_of(spark, sf, kind):
    e = with_msg(base.bip_split(spark, sf)).select("src", "tgt", "t", "edge_pos", "split", "msg")
    out = ij.generate(e, kind, 0.05, "test", "x")
    return out.select("src", "tgt", "t", F.get("msg", F.lit(0)).alias("qty"), "kind")


def strata(index, parts, size):
    return f"({index} * ({size} // {parts}) + ({index} * ({size} % {parts})) // {parts})"


LOW, HIGH = strata("(k - 1)", "take", "free"), strata("k", "take", "free")


@query("inject_temporal", f"""
WITH {TEST_ROWS},
gp AS (SELECT t - lag(t) OVER (ORDER BY t) AS g FROM (SELECT DISTINCT t FROM bs WHERE split = 'train')),
un AS (SELECT coalesce(list_reduce(list(g), lambda a, b : gcd(a, b)), 1) AS unit FROM gp WHERE g IS NOT NULL),
lt AS (SELECT unit, CASE WHEN (a + unit - 1) // unit <= b // unit THEN (a + unit - 1) // unit * unit ELSE a END AS start,
              greatest(1, b // unit - (a + unit - 1) // unit + 1) AS cells FROM tn, un),
cw AS (SELECT te.*, pow(count(*) OVER (PARTITION BY src, tgt), -1.5::DOUBLE) AS w FROM te),
hi AS (SELECT *, sum(w) OVER (ORDER BY edge_pos) AS hi FROM cw),
sh AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY edge_pos), 0) / (SELECT max(hi) FROM hi) AS lo, hi / (SELECT max(hi) FROM hi) AS up FROM hi),
dr AS (SELECT slot, {u01('x-temporal', "'edge'", 'slot')} AS u FROM range(0, (SELECT m FROM tn)) r(slot)),
pk AS (SELECT slot, src, tgt, qty, row_number() OVER (PARTITION BY src, tgt ORDER BY slot) AS k, count(*) OVER (PARTITION BY src, tgt) AS asked FROM dr JOIN sh ON u >= lo AND u < up),
se AS (SELECT src, tgt, i, i - row_number() OVER (PARTITION BY src, tgt ORDER BY i) + 1 AS before FROM (
  SELECT DISTINCT src, tgt, (t - start) // unit AS i FROM bs, lt WHERE t >= start AND (t - start) % unit = 0 AND t <= start + unit * (cells - 1))),
fr AS (SELECT pk.*, cells - coalesce(c, 0) AS free FROM pk LEFT JOIN (SELECT src, tgt, count(*) AS c FROM se GROUP BY 1, 2) USING (src, tgt), lt),
tk AS (SELECT *, least(asked, free) AS take FROM fr WHERE k <= free),
rk AS (SELECT *, {LOW} + CAST(floor({u01('x-temporal', "'time'", 'src', 'tgt', 'k')} * ({HIGH} - {LOW})) AS BIGINT) AS rank FROM tk)
SELECT rk.src, rk.tgt, any_value(start + (rank + coalesce(n, 0)) * unit)::BIGINT AS t, rk.qty, 'temporal' AS kind FROM lt, rk
LEFT JOIN (SELECT slot, count(*) AS n FROM rk JOIN se ON se.src = rk.src AND se.tgt = rk.tgt AND before <= rank GROUP BY 1) x USING (slot) GROUP BY slot, rk.src, rk.tgt, rk.qty""")
def inject_temporal(spark, sf):
    """Existing pairs at plausible times at which they were not seen.

    The SQL has no redraw of slots whose pair has no free time; there are none in the given tables.
    """
    return rows_of(spark, sf, "t")


@query("inject_contextual")
def inject_contextual(spark, sf):
    return rows_of(spark, sf, "c")


@query("inject_mixed")
def inject_mixed(spark, sf):
    return rows_of(spark, sf, "combination").groupBy("kind").agg(
        F.count("*").alias("generated"), F.min("t").alias("t_min"), F.max("t").alias("t_max")
    )


UNSEEN = f"""
WITH {BIP}, cand AS (SELECT a.edge_pos AS slot, a.src, b.tgt FROM bip a JOIN bip b ON b.edge_pos = a.edge_pos + 7),
mk AS (SELECT c.*, o.src IS NOT NULL AS seen FROM cand c LEFT JOIN (SELECT DISTINCT src, tgt FROM bip WHERE edge_pos % 3 > 0) o ON o.src = c.src AND o.tgt = c.tgt),
nw AS (SELECT *, row_number() OVER (ORDER BY {u01('un', "'pick'", 'slot')}, slot) AS rn FROM mk WHERE NOT seen),
od AS (SELECT *, row_number() OVER (ORDER BY slot) - 1 AS i, count(*) OVER () AS n FROM mk WHERE seen)"""


def selected(spark, sf, more, fallbacks):
    """Each edge's source with the target of the seventh edge after it, as a candidate."""
    e = base.bip(spark, sf)
    after = e.select((F.col("edge_pos") - 7).alias("slot"), "tgt")
    cand = e.select(F.col("edge_pos").alias("slot"), "src").join(after, "slot")
    seen = e.filter("edge_pos % 3 > 0")
    n = 500 if more is None else cand.join(seen.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti").count() + more
    return ij.select_unseen(cand, seen, n, "un", fallbacks=fallbacks).select("slot", "src", "tgt")


@query("select_unseen", UNSEEN + " SELECT slot, src, tgt FROM nw WHERE rn <= 500")
def select_unseen(spark, sf):
    return selected(spark, sf, None, False)


@query("select_fallback", UNSEEN + f"""
SELECT slot, src, tgt FROM nw
UNION ALL SELECT od.slot, src, tgt FROM (SELECT {pick('(SELECT max(n) FROM od)', 'un', "'fallback'", 'id')} AS i FROM range(0, 300) r(id)) JOIN od USING (i)""")
def select_fallback(spark, sf):
    """300 more than there are unseen candidates: the rest are observed ones."""
    return selected(spark, sf, 300, True)


@query("inject_report", f"""
WITH {BIP_S}, ra AS (SELECT unnest(['val', 'test', 'train']) AS split, unnest([0.02, 0.05, 0.0]) AS ratio),
n AS (SELECT split, ratio::DOUBLE AS ratio, CAST(floor((SELECT count(*) FROM bs WHERE bs.split = ra.split) * ratio::DOUBLE) AS BIGINT) AS n FROM ra),
fr AS (SELECT s.split, count(*) AS free FROM (SELECT DISTINCT split, src FROM bs) s JOIN (SELECT DISTINCT split, tgt FROM bs) g ON g.split = s.split
       LEFT JOIN (SELECT DISTINCT src, tgt, 1 AS seen FROM bs) o ON o.src = s.src AND o.tgt = g.tgt WHERE seen IS NULL AND s.src <> g.tgt GROUP BY 1),
md AS (SELECT n.*, least(n, coalesce(free, 0)) AS made FROM n LEFT JOIN fr USING (split))
SELECT split, ratio, n AS requested, made AS generated, (SELECT count(*) FROM bs) + (SELECT sum(made) FROM md)::BIGINT AS total, 0::BIGINT AS out_of_order FROM md""")
def inject_report(spark, sf):
    """Structural anomalies in two splits: requested and generated, and the final order."""
    e = with_msg(base.bip_split(spark, sf)).select("src", "tgt", "t", "edge_pos", "split", "msg")
    out, report = ij.inject_rows(e, "structural", {"val": 0.02, "test": 0.05, "train": 0.0}, "rep")
    after = out.select((F.col("edge_pos") - 1).alias("edge_pos"), F.col("t").alias("t2"), F.col("src").alias("s2"))
    wrong = out.join(after, "edge_pos", "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("t2").isNotNull() & (F.struct("t", "src") > F.struct(F.col("t2").alias("t"), F.col("s2").alias("src")))).alias("out_of_order")
    )
    return report.join(F.broadcast(wrong))


@query("nearby_targets")
def nearby_targets(spark, sf):
    e = base.bip_split(spark, sf).filter(F.col("split") == "test").select("src", "tgt", "t", "edge_pos")
    return ij.nearby_targets(e, e.count() // 20, 10, "near")


def unseen_sql(seed, n, filt="TRUE", extra=""):
    ends = "u, v" if extra else "a AS u, b AS v"
    return f"""
{permuted('pm', '(SELECT n * n FROM nn)', seed, f'40 * ({n}) + 400')},
c AS (SELECT cand, {ends} FROM (SELECT cand, code // n AS a, code % n AS b FROM pm, nn) q {extra}),
f AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, min(cand) AS cand FROM c WHERE u <> v AND {filt} GROUP BY 1, 2),
k AS (SELECT cand, row_number() OVER (ORDER BY cand) - 1 AS slot FROM f LEFT JOIN (SELECT DISTINCT src, tgt FROM ug) o ON o.src = lo AND o.tgt = hi WHERE o.src IS NULL),
w AS (SELECT slot, u, v FROM k JOIN c USING (cand) WHERE slot < ({n}))"""


N2 = "(SELECT count(*) // 50 FROM ug)"
NN = "nn AS (SELECT max(greatest(src, tgt)) + 1 AS n FROM ug)"


@query("labelled_test_set", f"""
WITH {UG}, cut AS (SELECT count(*) AS tot, CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) AS c FROM ug),
p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (
  SELECT src AS v FROM ug, cut WHERE edge_pos < c UNION SELECT tgt FROM ug, cut WHERE edge_pos < c)),
nn AS (SELECT count(*) AS n FROM p),
m AS (SELECT CAST(floor((tot - c) * 0.05::DOUBLE / (1.0::DOUBLE - 0.05::DOUBLE + 1e-10)) AS BIGINT) AS m FROM cut),
{unseen_sql('lt', '(SELECT m FROM m)', extra='JOIN (SELECT i, v AS u FROM p) x ON x.i = q.a JOIN (SELECT i, v FROM p) y ON y.i = q.b')}
SELECT src, tgt, CAST(0 AS INTEGER) AS label FROM ug, cut WHERE edge_pos >= c
UNION ALL SELECT u, v, CAST(1 AS INTEGER) FROM w""")
def labelled_test_set(spark, sf):
    return ij.labelled_test_set(base.ugraph(spark, sf), 0.5, 0.05, "lt").drop("_u")


@query("uniform_unseen", f"""
WITH {UG}, {NN}, {unseen_sql('uu', N2)}
SELECT slot, w.u AS src, w.v AS tgt, t FROM w JOIN ug ON edge_pos = {pick('(SELECT count(*) FROM ug)', 'uu', "'row'", 'slot')}""")
def uniform_unseen(spark, sf):
    e = base.ugraph(spark, sf)
    return ij.uniform_unseen(e, num_nodes(e), e.count() // 50, "uu")


@query("between_communities", f"""
WITH {UG}, p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT src AS v FROM ug UNION SELECT tgt FROM ug)),
nn AS (SELECT count(*) AS n FROM p),
{unseen_sql('bc', N2, filt='u % 8 <> v % 8', extra='JOIN (SELECT i, v AS u FROM p) x ON x.i = q.a JOIN (SELECT i, v FROM p) y ON y.i = q.b')}
SELECT slot, u AS src, v AS tgt FROM w""")
def between_communities(spark, sf):
    return ij.between_communities(base.ugraph(spark, sf), communities(spark, sf), base.ugraph(spark, sf).count() // 50, "bc")


@query("scattered_anomalies", f"""
WITH {UG_S}, {NN}, {unseen_sql('sc', N2)},
te AS (SELECT src, tgt, row_number() OVER (ORDER BY edge_pos) - 1 AS i FROM us WHERE split = 'test'),
nw AS (SELECT count(*) AS n FROM w),
sp AS (SELECT id, row_number() OVER (ORDER BY {u01('sc', "'spot'", 'id')}, id) - 1 AS r FROM range(0, (SELECT count(*) FROM te) + (SELECT n FROM nw)) q(id)),
tk AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot FROM sp, nw WHERE r < n),
fr AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM sp, nw WHERE r >= n)
SELECT id AS place, src, tgt, CAST(0 AS INTEGER) AS label FROM te JOIN fr USING (i)
UNION ALL SELECT id, u, v, CAST(1 AS INTEGER) FROM w JOIN tk USING (slot)""")
def scattered_anomalies(spark, sf):
    e = base.ugraph_split(spark, sf)
    new = ij.uniform_unseen(e, num_nodes(e), e.count() // 50, "sc")
    return ij.scatter_into(e.filter(F.col("split") == "test"), new, "sc")


# --- negatives -------------------------------------------------------------

SNAP = UG_S + """, sn AS (SELECT *, CAST(edge_pos // 500 AS BIGINT) AS snapshot_id FROM us),
nn AS (SELECT max(greatest(src, tgt)) + 1 AS n FROM us)"""


def snaps(spark, sf):
    return tl.whole_table_snapshots(base.ugraph_split(spark, sf), 500)


def negative_sql(seed, ok, join, tries):
    return f"""
c AS (SELECT edge_pos AS slot, snapshot_id, try, {pick('n', seed, "'u'", 'edge_pos', 'try')} AS u, {pick('n', seed, "'v'", 'edge_pos', 'try')} AS v
      FROM sn, nn, range(0, {tries}) r(try)),
g AS (SELECT c.* FROM c {join} WHERE {ok}),
b AS (SELECT slot, snapshot_id, u, v FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY try) AS rn FROM g) WHERE rn = 1)
SELECT slot, snapshot_id, u, v FROM b"""


PAIR = "least(u, v) = o.src AND greatest(u, v) = o.tgt"


@query("negatives_snapshot", f"""
WITH {SNAP}, o AS (SELECT DISTINCT src, tgt, snapshot_id FROM sn),
{negative_sql('ns', 'u <> v AND o.src IS NULL', f'LEFT JOIN o ON {PAIR} AND o.snapshot_id = c.snapshot_id', 16)}""")
def negatives_snapshot(spark, sf):
    e = snaps(spark, sf)
    return ng.per_snapshot(e, num_nodes(e), "ns")


@query("negatives_upper", f"""
WITH {SNAP}, o AS (SELECT DISTINCT src, tgt, snapshot_id FROM sn),
{negative_sql('nu', 'u < v AND o.src IS NULL', f'LEFT JOIN o ON {PAIR} AND o.snapshot_id = c.snapshot_id', 32)}""")
def negatives_upper(spark, sf):
    e = snaps(spark, sf)
    return ng.per_snapshot(e, num_nodes(e), "nu", upper=True)


@query("negatives_uniform", f"""
WITH {SNAP}, o AS (SELECT src, tgt, min(snapshot_id) AS since FROM sn GROUP BY 1, 2),
{negative_sql('nc', 'u <> v AND (o.since IS NULL OR o.since > c.snapshot_id)', f'LEFT JOIN o ON {PAIR}', 248)}""")
def negatives_uniform(spark, sf):
    e = snaps(spark, sf)
    return ng.against_history(e, num_nodes(e), "nc")


@query("negatives_corrupt", f"""
WITH {SNAP}, x AS (SELECT *, {u01('co', "'side'", 'edge_pos')} < 0.5 AS l, {pick('n', 'co', "'node'", 'edge_pos')} AS o FROM sn, nn)
SELECT edge_pos, CASE WHEN l THEN o ELSE src END AS src, CASE WHEN l THEN tgt ELSE o END AS tgt FROM x""")
def negatives_corrupt(spark, sf):
    e = snaps(spark, sf)
    return ng.corrupt_endpoint(e, num_nodes(e), "co").select("edge_pos", "src", "tgt")


@query("negatives_degree", f"""
WITH {SNAP}, o AS (SELECT src, tgt, min(snapshot_id) AS since FROM sn GROUP BY 1, 2),
e2 AS (SELECT snapshot_id, src AS v FROM sn UNION ALL SELECT snapshot_id, tgt FROM sn),
d AS (SELECT snapshot_id, v, count(*) AS d FROM e2 GROUP BY 1, 2),
fs AS (SELECT v, min(snapshot_id) AS f FROM e2 GROUP BY 1),
ids AS (SELECT r.v, coalesce(f, 1000000) AS f FROM nn, range(0, n) r(v) LEFT JOIN fs ON fs.v = r.v),
th AS (SELECT s.snapshot_id, coalesce(min(ids.v), (SELECT n FROM nn)) AS bound FROM (SELECT DISTINCT snapshot_id FROM sn) s LEFT JOIN ids ON ids.f > s.snapshot_id GROUP BY 1),
a AS (SELECT edge_pos AS slot, sn.snapshot_id, bound, CASE WHEN {u01('dw', "'keep'", 'edge_pos')} < x.d / (x.d + y.d)::DOUBLE THEN tgt ELSE src END AS kept
      FROM sn JOIN d x ON x.snapshot_id = sn.snapshot_id AND x.v = src JOIN d y ON y.snapshot_id = sn.snapshot_id AND y.v = tgt JOIN th ON th.snapshot_id = sn.snapshot_id),
c AS (SELECT slot, snapshot_id, kept AS u, try, {pick('bound', 'dw', "'v'", 'slot', 'try')} AS v FROM a, range(0, 120) r(try)),
c2 AS (SELECT slot, snapshot_id, kept AS u, 1000 + try AS try, {pick('n', 'dw-any', "'v'", 'slot', 'try')} AS v FROM a, nn, range(0, 56) r(try)),
g AS (SELECT q.* FROM (SELECT * FROM c UNION ALL SELECT * FROM c2) q LEFT JOIN o ON {PAIR} WHERE u <> v AND (o.since IS NULL OR o.since > q.snapshot_id)),
b AS (SELECT slot, v FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY try) AS rn FROM g) WHERE rn = 1)
SELECT slot, snapshot_id, kept, CAST(coalesce(b.v, CASE WHEN {pick('(n - 1)', 'dw-last', 'slot')} >= kept THEN {pick('(n - 1)', 'dw-last', 'slot')} + 1 ELSE {pick('(n - 1)', 'dw-last', 'slot')} END) AS BIGINT) AS v
FROM a LEFT JOIN b USING (slot), nn""")
def negatives_degree(spark, sf):
    e = snaps(spark, sf)
    return ng.degree_weighted(e, num_nodes(e), "dw")


@query("negatives_pool", f"""
WITH {UG_S},
s AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS i FROM (SELECT DISTINCT src FROM us)),
g AS (SELECT tgt, row_number() OVER (ORDER BY tgt) - 1 AS i FROM (SELECT DISTINCT tgt FROM us))
SELECT draw, src, tgt FROM (SELECT draw, {pick('(SELECT count(*) FROM s)', 'rp', "'src'", 'draw')} AS a, {pick('(SELECT count(*) FROM g)', 'rp', "'tgt'", 'draw')} AS b FROM range(0, (SELECT count(*) FROM us)) r(draw)) q
JOIN s ON s.i = a JOIN g ON g.i = b""")
def negatives_pool(spark, sf):
    e = base.ugraph_split(spark, sf)
    return product_sample(spark, [("src", e, "src"), ("tgt", e, "tgt")], e.count(), "rp")


@query("train_node_pool", f"""
WITH {UG_S} SELECT src AS node_id FROM us WHERE split = 'train' UNION SELECT tgt FROM us WHERE split = 'train'""")
def train_node_pool(spark, sf):
    return ng.train_pool(base.ugraph_split(spark, sf))


@query("unseen_products", f"""
WITH {UG}, s AS (SELECT DISTINCT src FROM ug), g AS (SELECT DISTINCT tgt FROM ug)
SELECT src, tgt FROM s, g WHERE src <> tgt AND NOT EXISTS (SELECT 1 FROM ug u WHERE u.src = least(s.src, g.tgt) AND u.tgt = greatest(s.src, g.tgt))""")
def unseen_products(spark, sf):
    e = base.ugraph(spark, sf)
    return pair_product(e, e, without=observed_pairs(e)).filter(F.col("src") != F.col("tgt")).select("src", "tgt")
