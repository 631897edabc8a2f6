"""Cleaning, splitting and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.sql import BIP, BIP_S, UG, UG_S, pick, u01
from tgraph.operators import structure as st
from tgraph.operators import timeline as tl
from tgraph.operators.metrics import average_precision, roc_auc
from tgraph.operators.ordering import global_position, shifted
from tgraph.plans import base

QUERIES, ORACLE, query = register()


def raw_links(spark, sf):
    """Event pairs before cleaning: self-loops, repeats, both directions."""
    e = base.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("edge_id"),
        F.col("user_id").alias("src"),
        F.pmod(F.col("user_id") * 7 + F.col("event_id") % 13, F.lit(50)).alias("tgt"),
        F.floor(base.micros("ts") / F.lit(3_600_000_000)).cast("bigint").alias("t"),
        F.when(F.col("event_id") % 2 == 0, "train").otherwise("test").alias("split"),
    )


RAW = """
raw AS (
  SELECT event_id AS edge_id, user_id AS src,
         (user_id * 7 + event_id % 13) % 50 AS tgt,
         CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS t,
         CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'test' END AS split
  FROM events)
"""


@query("canonical_dedup", f"""
WITH {RAW}
SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, t, min(edge_id) AS edge_id
FROM raw WHERE src <> tgt GROUP BY 1, 2, 3""")
def canonical_dedup(spark, sf):
    e = st.canonical(st.drop_self_loops(raw_links(spark, sf).drop("split")))
    return st.dedup(e)


@query("directed_dedup", f"""
WITH {RAW} SELECT src, tgt, t, min(edge_id) AS edge_id FROM raw GROUP BY 1, 2, 3""")
def directed_dedup(spark, sf):
    return st.dedup(raw_links(spark, sf).drop("split"))


@query("train_only_cleaning", f"""
WITH {RAW}, tr AS (
  SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, t, min(edge_id) AS edge_id
  FROM raw WHERE split = 'train' AND src <> tgt GROUP BY 1, 2, 3)
SELECT src, tgt, t, edge_id, 'train' AS split FROM tr
UNION ALL SELECT src, tgt, t, edge_id, split FROM raw WHERE split <> 'train'""")
def train_only_cleaning(spark, sf):
    e = st.drop_self_loops(raw_links(spark, sf), train_only=True)
    return st.dedup(st.canonical(e, train_only=True), train_only=True)


@query("undirected", f"""
WITH {RAW}
SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, t, min(edge_id) AS edge_id
FROM raw GROUP BY 1, 2, 3""")
def undirected(spark, sf):
    return st.undirected(raw_links(spark, sf).drop("split"))


@query("undirected_pairs", f"""
WITH {UG}, p AS (SELECT src, tgt, min(edge_pos) AS edge_pos FROM ug GROUP BY 1, 2)
SELECT src, tgt, edge_pos FROM p UNION ALL SELECT tgt, src, edge_pos FROM p""")
def undirected_pairs(spark, sf):
    return st.undirected_pairs(base.ugraph(spark, sf))


@query("reversed_expansion", f"""
WITH {UG} SELECT src, tgt, t, edge_pos FROM ug UNION ALL SELECT tgt, src, t, edge_pos FROM ug""")
def reversed_expansion(spark, sf):
    return st.with_reversed(base.ugraph(spark, sf))


@query("self_loop_expansion", f"""
WITH {UG}, n AS (SELECT src AS v FROM ug UNION SELECT tgt FROM ug)
SELECT src, tgt, t FROM ug UNION ALL SELECT v, v, 0 FROM n""")
def self_loop_expansion(spark, sf):
    return st.add_self_loops(base.ugraph(spark, sf), ["t"])


@query("reindex_nodes", f"""
WITH {BIP}, n AS (
  SELECT v, row_number() OVER (ORDER BY v) - 1 AS i
  FROM (SELECT src AS v FROM bip UNION SELECT tgt FROM bip))
SELECT a.i AS src, b.i AS tgt, edge_pos FROM bip JOIN n a ON src = a.v JOIN n b ON tgt = b.v""")
def reindex_nodes(spark, sf):
    e = base.bip(spark, sf).select("src", "tgt", "edge_pos")
    return st.reindex_nodes(e)[0]


@query("dict_encode", """
WITH e AS (
  SELECT event_id, event_type AS src, json_extract_string(props, '$.k') AS tgt FROM events),
n AS (
  SELECT v, row_number() OVER (ORDER BY v) - 1 AS i
  FROM (SELECT src AS v FROM e UNION SELECT tgt FROM e))
SELECT event_id, a.i AS src, b.i AS tgt FROM e JOIN n a ON src = a.v JOIN n b ON tgt = b.v""")
def dict_encode(spark, sf):
    e = base.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("src"),
        F.get_json_object("props", "$.k").alias("tgt"),
    )
    return st.reindex_nodes(e)[0]


@query("node_mapping", f"""
WITH {UG}
SELECT v AS original_id, row_number() OVER (ORDER BY v) - 1 AS new_id
FROM (SELECT src AS v FROM ug UNION SELECT tgt FROM ug)""")
def node_mapping(spark, sf):
    return st.node_mapping(base.ugraph(spark, sf))


@query("bipartite_offset", """
WITH e AS (SELECT o_custkey AS src, l_suppkey AS tgt, l_orderkey, l_linenumber
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT src, tgt + (SELECT count(DISTINCT src) FROM e) AS tgt, l_orderkey, l_linenumber FROM e""")
def bipartite_offset(spark, sf):
    o, l = base.table(spark, sf, "orders"), base.table(spark, sf, "lineitem")
    e = o.join(l, o.o_orderkey == l.l_orderkey).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("tgt"),
        "l_orderkey", "l_linenumber",
    )
    return st.bipartite_offset(e, "count")


@query("node_types", f"""
WITH {BIP}
SELECT v AS node_id, CAST(min(k) AS INTEGER) AS node_type
FROM (SELECT src AS v, 0 AS k FROM bip UNION ALL SELECT tgt, 1 FROM bip) GROUP BY 1""")
def node_types(spark, sf):
    return st.node_types(base.bip(spark, sf))


@query("endpoint_labels", f"""
WITH {UG}, lab AS (SELECT vec_id AS node_id, CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END AS label FROM embeddings)
SELECT src, tgt, t, CAST(CASE WHEN coalesce(a.label, 0) = 1 OR coalesce(b.label, 0) = 1 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM ug LEFT JOIN lab a ON src = a.node_id LEFT JOIN lab b ON tgt = b.node_id""")
def endpoint_labels(spark, sf):
    lab = base.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("node_id"), F.when(F.col("label") % 2 == 1, 1).otherwise(0).alias("label")
    )
    return st.endpoint_labels(base.ugraph(spark, sf).select("src", "tgt", "t"), lab)


@query("label_recode", f"""
WITH {BIP}, e AS (SELECT edge_pos, CASE WHEN label = 1 THEN -1 ELSE 1 END AS label FROM bip)
SELECT edge_pos, CAST(CASE label WHEN -1 THEN 1 ELSE 0 END AS INTEGER) AS recoded,
       CAST(CASE WHEN label <> 0 THEN 1 ELSE 0 END AS INTEGER) AS binary_label,
       CAST(1 - label AS INTEGER) AS flipped FROM e""")
def label_recode(spark, sf):
    e = base.bip(spark, sf).select(
        "edge_pos", F.when(F.col("label") == 1, -1).otherwise(1).alias("label")
    )
    return e.select(
        "edge_pos", st.recode_labels().alias("recoded"),
        st.binarize().alias("binary_label"), st.flip("label").alias("flipped"),
    )


@query("mask_labels", f"""
WITH {BIP_S}
SELECT edge_pos, split, CAST(CASE WHEN split = 'train' AND {u01('mask', 'edge_pos')} < 0.3 THEN -1 ELSE label END AS INTEGER) AS label
FROM bs""")
def mask_labels(spark, sf):
    e = base.bip_split(spark, sf).select("edge_pos", "split", "label")
    return st.mask_labels(e, 0.3, "mask", "edge_pos")


@query("label_noise", f"""
WITH {BIP_S}, r AS (
  SELECT edge_pos, row_number() OVER (ORDER BY {u01('noise', 'edge_pos')}, edge_pos) AS rn, count(*) OVER () AS n
  FROM bs WHERE split = 'train')
SELECT b.edge_pos, split,
       CAST(CASE WHEN r.rn <= CAST(floor(n * 0.1) AS BIGINT) THEN 1 - label ELSE label END AS INTEGER) AS label
FROM bs b LEFT JOIN r ON b.edge_pos = r.edge_pos""")
def label_noise(spark, sf):
    e = base.bip_split(spark, sf).select("edge_pos", "split", "label")
    return st.flip_label_noise(e, 0.1, "noise", "edge_pos")


@query("upsample_positives", f"""
WITH {BIP_S}, p AS (
  SELECT *, row_number() OVER (ORDER BY edge_pos) - 1 AS i FROM bs WHERE split = 'train' AND label = 1),
d AS (SELECT id AS copy, {pick('(SELECT count(*) FROM p)', 'up', 'id')} AS i
      FROM range(1, 2 * (SELECT count(*) FROM p) + 1) r(id))
SELECT edge_pos, src, label, split, 0::BIGINT AS copy FROM bs
UNION ALL SELECT edge_pos, src, label, split, copy FROM d JOIN p USING (i)""")
def upsample_positives(spark, sf):
    e = base.bip_split(spark, sf).select("edge_pos", "src", "label", "split")
    return st.upsample_positives(e, 2, "up")


@query("edge_dropout", f"""
WITH {UG} SELECT src, tgt, t, edge_pos FROM ug WHERE {u01('drop', 'edge_pos')} >= 0.4""")
def edge_dropout(spark, sf):
    return st.drop_rows(base.ugraph(spark, sf), 0.4, "drop", "edge_pos")


@query("edge_weights", f"""
WITH {UG}, c AS (SELECT src, tgt, count(*) AS n FROM ug GROUP BY 1, 2)
SELECT edge_pos, n AS freq,
       round(pow(n, -1.5) / ((SELECT sum(n * pow(n, -1.5)) FROM c) + 1e-10), 12) AS p_rows,
       round(pow(n, -1.5) / ((SELECT sum(pow(n, -1.5)) FROM c) + 1e-10), 12) AS p_unique
FROM ug JOIN c USING (src, tgt)""")
def edge_weights(spark, sf):
    e = st.edge_frequency(base.ugraph(spark, sf))
    rows = st.inverse_frequency(e).withColumnRenamed("p", "p_rows")
    both = st.inverse_frequency(rows, "unique")
    return both.select(
        "edge_pos", "freq", F.round("p_rows", 12).alias("p_rows"), F.round("p", 12).alias("p_unique")
    )


@query("first_occurrence", f"""
WITH {UG} SELECT src, min(edge_pos) AS first_pos FROM ug GROUP BY 1""")
def first_occurrence(spark, sf):
    return st.first_occurrence(base.ugraph(spark, sf), "src")


@query("time_normalize", """
SELECT event_id, epoch_us(ts) AS t_stamp,
       CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS t_date,
       event_id * 3 AS t_whole,
       CAST(round((event_id + (event_id % 8) / 8.0) * 1000) AS BIGINT) AS t_frac
FROM events""")
def time_normalize(spark, sf):
    e = base.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("t_stamp"), F.to_date("ts").alias("t_date"),
        (F.col("event_id") * 3).cast("double").alias("t_whole"),
        (F.col("event_id") + (F.col("event_id") % 8) / F.lit(8.0)).alias("t_frac"),
    )
    for c in ("t_stamp", "t_date", "t_whole", "t_frac"):
        e = tl.normalize_time(e, c)
    return e


@query("quantile_split", f"""
WITH {BIP_S} SELECT split, count(*) AS edges, min(t) AS t_min, max(t) AS t_max FROM bs GROUP BY 1""")
def quantile_split(spark, sf):
    return base.bip_split(spark, sf).groupBy("split").agg(
        F.count("*").alias("edges"), F.min("t").alias("t_min"), F.max("t").alias("t_max")
    )


@query("rowcount_split", f"""
WITH {UG}, s AS (
  SELECT *, CASE WHEN edge_pos < CAST(floor(n * 0.7) AS BIGINT) THEN 'train'
                 WHEN edge_pos < CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'val'
                 ELSE 'test' END AS split
  FROM ug, (SELECT count(*) AS n FROM ug))
SELECT edge_pos, split FROM s""")
def rowcount_split(spark, sf):
    return tl.split_by_rows(base.ugraph(spark, sf), "edge_pos", 0.7, 0.1).select("edge_pos", "split")


@query("event_order", f"WITH {BIP} SELECT src, tgt, t, edge_pos FROM bip")
def event_order(spark, sf):
    return tl.event_order(base.bip(spark, sf).select("src", "tgt", "t"))


@query("snap_count", f"""
WITH {BIP_S}, p AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY edge_pos) - 1) / 2000) AS BIGINT) AS snapshot_id FROM bs)
SELECT split, snapshot_id, count(*) AS edges, CAST(sum(label) AS BIGINT) AS positives, min(t) AS t_min, max(t) AS t_max
FROM p GROUP BY 1, 2""")
def snap_count(spark, sf):
    e = tl.count_snapshots(base.bip_split(spark, sf), 2000)
    return e.groupBy("split", "snapshot_id").agg(
        F.count("*").alias("edges"), F.sum("label").alias("positives"),
        F.min("t").alias("t_min"), F.max("t").alias("t_max"),
    )


US_SNAP = UG_S + """, cs AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY split ORDER BY edge_pos) - 1) / 500) AS BIGINT) AS local FROM us),
co AS (SELECT split, max(local) + 1 AS n FROM cs GROUP BY 1),
sn AS (
  SELECT cs.*, local + CASE split WHEN 'train' THEN 0
           WHEN 'val' THEN (SELECT n FROM co WHERE split = 'train')
           ELSE (SELECT sum(n) FROM co WHERE split <> 'test') END AS snapshot_id FROM cs)
"""


@query("snap_continued", f"""
WITH {US_SNAP} SELECT edge_pos, split, CAST(snapshot_id AS BIGINT) AS snapshot_id FROM sn""")
def snap_continued(spark, sf):
    return tl.continued_snapshots(base.ugraph_split(spark, sf), 500).select(
        "edge_pos", "split", "snapshot_id"
    )


@query("snap_whole", f"""
WITH {UG} SELECT edge_pos, CAST(floor(edge_pos / 700) AS BIGINT) AS snapshot_id FROM ug""")
def snap_whole(spark, sf):
    return tl.whole_table_snapshots(base.ugraph(spark, sf), 700).select("edge_pos", "snapshot_id")


@query("snap_time", f"""
WITH {UG_S}, r AS (
  SELECT *, CAST(floor((t - (SELECT min(t) FROM us)) // 86400000000) AS BIGINT) AS raw FROM us),
b AS (SELECT split, min(raw) AS lo, max(raw) AS hi FROM r GROUP BY 1),
m AS (
  SELECT CASE WHEN v.lo = tr.hi THEN 1 ELSE 0 END AS mv,
         CASE WHEN te.lo = v.hi + CASE WHEN v.lo = tr.hi THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS mt
  FROM (SELECT * FROM b WHERE split = 'train') tr, (SELECT * FROM b WHERE split = 'val') v,
       (SELECT * FROM b WHERE split = 'test') te)
SELECT edge_pos, split, CAST(raw + CASE split WHEN 'val' THEN mv WHEN 'test' THEN mt ELSE 0 END AS BIGINT) AS snapshot_id
FROM r, m""")
def snap_time(spark, sf):
    return tl.time_snapshots(base.ugraph_split(spark, sf), 86_400_000_000).select(
        "edge_pos", "split", "snapshot_id"
    )


@query("snap_event", f"""
WITH {UG_S}, f AS (
  SELECT *, CASE WHEN src IS DISTINCT FROM lag(src) OVER (PARTITION BY split ORDER BY edge_pos) THEN 1 ELSE 0 END AS n FROM us)
SELECT edge_pos, split, CAST(sum(n) OVER (PARTITION BY split ORDER BY edge_pos) - 1 AS BIGINT) AS snapshot_id FROM f""")
def snap_event(spark, sf):
    return tl.event_snapshots(base.ugraph_split(spark, sf)).select("edge_pos", "split", "snapshot_id")


@query("snap_instant", f"""
WITH {BIP} SELECT edge_pos, dense_rank() OVER (ORDER BY t) - 1 AS snapshot_id FROM bip""")
def snap_instant(spark, sf):
    return tl.instant_snapshots(base.bip(spark, sf)).select("edge_pos", "snapshot_id")


@query("snap_cumulative", f"""
WITH {US_SNAP}, e AS (SELECT split, CAST(snapshot_id AS BIGINT) AS snapshot_id, count(*) AS current_edges, max(edge_pos) AS lp FROM sn GROUP BY 1, 2),
f AS (SELECT v, min(edge_pos) AS seen_at FROM (SELECT src AS v, edge_pos FROM ug UNION ALL SELECT tgt, edge_pos FROM ug) GROUP BY 1)
SELECT split, snapshot_id, current_edges, lp + 1 AS cumulative_edges,
       (SELECT count(*) FROM f WHERE seen_at <= lp) AS cumulative_nodes FROM e""")
def snap_cumulative(spark, sf):
    return tl.cumulative_summary(tl.continued_snapshots(base.ugraph_split(spark, sf), 500))


@query("snap_summary", f"""
WITH {US_SNAP}, n AS (
  SELECT split, snapshot_id, count(DISTINCT v) AS num_nodes
  FROM (SELECT split, snapshot_id, src AS v FROM sn UNION ALL SELECT split, snapshot_id, tgt FROM sn) GROUP BY 1, 2)
SELECT split, CAST(s.snapshot_id AS BIGINT) AS snapshot_id, count(*) AS num_edges, min(t) AS t_min, max(t) AS t_max,
       max(t) - min(t) AS span, num_nodes, round(2.0 * count(*) / num_nodes, 9) AS mean_degree
FROM sn s JOIN n USING (split, snapshot_id) GROUP BY split, s.snapshot_id, num_nodes""")
def snap_summary(spark, sf):
    s = tl.snapshot_summary(tl.continued_snapshots(base.ugraph_split(spark, sf), 500))
    return s.withColumn("mean_degree", F.round("mean_degree", 9))


@query("split_snapshot_report", f"""
WITH {US_SNAP}, l AS (SELECT sn.*, CASE WHEN (src + tgt) % 17 = 0 THEN 1 ELSE 0 END AS label FROM sn)
SELECT split, count(DISTINCT snapshot_id) AS snapshots, count(*) AS edges, CAST(sum(label) AS BIGINT) AS anomalies,
       round(sum(label) / count(*)::DOUBLE, 9) AS ratio FROM l GROUP BY 1""")
def split_snapshot_report(spark, sf):
    e = tl.continued_snapshots(base.ugraph_split(spark, sf), 500).withColumn(
        "label", ((F.col("src") + F.col("tgt")) % 17 == 0).cast("bigint")
    )
    return e.groupBy("split").agg(
        F.countDistinct("snapshot_id").alias("snapshots"), F.count("*").alias("edges"),
        F.sum("label").alias("anomalies"),
        F.round(F.sum("label") / F.count("*"), 9).alias("ratio"),
    )


@query("snapshot_lookback", f"""
WITH {US_SNAP}
SELECT edge_pos, CAST(snapshot_id AS BIGINT) AS snapshot_id, CAST(snapshot_id - o AS BIGINT) AS lookback_id
FROM sn, range(0, 3) r(o) WHERE snapshot_id - o >= 0""")
def snapshot_lookback(spark, sf):
    e = tl.continued_snapshots(base.ugraph_split(spark, sf), 500)
    return tl.lookback(e.select("edge_pos", "snapshot_id"), 3)


@query("snapshot_iteration", f"""
WITH {US_SNAP}, n AS (SELECT snapshot_id, src AS v FROM sn UNION SELECT snapshot_id, tgt FROM sn)
SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, v AS node_id, snapshot_id = min(snapshot_id) OVER (PARTITION BY v) AS is_new, label
FROM n LEFT JOIN embeddings ON vec_id = v""")
def snapshot_iteration(spark, sf):
    """The nodes of every snapshot, and those that are new in it, with their labels."""
    e = tl.continued_snapshots(base.ugraph_split(spark, sf), 500)
    nodes = base.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "label")
    return tl.iterate_nodes(e).join(nodes, "node_id", "left").select("snapshot_id", "node_id", "is_new", "label")


@query("shared_nodes", f"""
WITH {US_SNAP}, n AS (
  SELECT DISTINCT snapshot_id, v FROM (SELECT snapshot_id, src AS v FROM sn UNION ALL SELECT snapshot_id, tgt FROM sn))
SELECT CAST(a.snapshot_id AS BIGINT) AS snapshot_id, count(*) AS shared
FROM n a JOIN n b ON a.v = b.v AND b.snapshot_id = a.snapshot_id - 1 GROUP BY 1""")
def shared_nodes(spark, sf):
    e = tl.continued_snapshots(base.ugraph_split(spark, sf), 500)
    return tl.shared_nodes(e).groupBy("snapshot_id").agg(F.count("*").alias("shared"))


@query("time_since_last", f"""
WITH {UG}, x AS (SELECT src AS v, t, edge_pos FROM ug UNION ALL SELECT tgt, t, edge_pos FROM ug)
SELECT * FROM (SELECT v, edge_pos, t - lag(t) OVER (PARTITION BY v ORDER BY t, edge_pos) AS delta FROM x) WHERE delta IS NOT NULL""")
def time_since_last(spark, sf):
    ends = base.ugraph(spark, sf).select(F.explode(F.array("src", "tgt")).alias("v"), "t", "edge_pos")
    placed = global_position(ends, ["v", "edge_pos"], "p")
    out = shifted(placed, "p", {"_last": F.col("t")}, -1, ["v"])
    out = out.filter(F.col("_last").isNotNull())
    return out.select("v", "edge_pos", (F.col("t") - F.col("_last")).alias("delta"))


@query("time_granularity", f"""
WITH {BIP_S}, d AS (SELECT t - lag(t) OVER (ORDER BY t) AS delta FROM (SELECT DISTINCT t FROM bs WHERE split = 'train')),
c AS (SELECT delta, count(*) AS n FROM d WHERE delta IS NOT NULL GROUP BY 1)
SELECT delta, n, round(pow(n, -1.5) / ((SELECT sum(pow(n, -1.5)) FROM c) + 1e-10), 12) AS p,
       86400000000::BIGINT * list_reduce((SELECT list(delta // 86400000000) FROM c), lambda a, b: gcd(a, b)) AS granularity
FROM c""")
def time_granularity(spark, sf):
    from tgraph.operators.inject import time_deltas

    train = base.bip_split(spark, sf).filter(F.col("split") == "train")
    d = time_deltas(train)
    return d.withColumn("p", F.round("p", 12))


@query("pair_novelty_score", f"""
WITH {BIP_S}, k AS (SELECT src, tgt, count(*) AS k FROM bs WHERE split = 'train' GROUP BY 1, 2),
s AS (SELECT label AS y, 1.0::DOUBLE / (1 + coalesce(k, 0)) AS s FROM bs LEFT JOIN k USING (src, tgt) WHERE split = 'test'),
g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1),
w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS nb, sum(p) OVER (ORDER BY s DESC) AS tp,
             sum(p + n) OVER (ORDER BY s DESC) AS pp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g)
SELECT round(sum(p * (nb + 0.5::DOUBLE * n)) / max(np * nn), 9) AS roc_auc,
       round(sum(p * tp::DOUBLE / pp) / max(np), 9) AS average_precision FROM w""")
def pair_novelty_score(spark, sf):
    e = base.bip_split(spark, sf)
    known = e.filter(F.col("split") == "train").groupBy("src", "tgt").agg(F.count("*").alias("k"))
    scored = e.filter(F.col("split") == "test").join(known, ["src", "tgt"], "left").select(
        "label", (F.lit(1.0) / (F.lit(1) + F.coalesce("k", F.lit(0)))).alias("score")
    )
    auc, ap = roc_auc(scored), average_precision(scored).first()["average_precision"]
    return auc.select(F.round("roc_auc", 9).alias("roc_auc"), F.round(F.lit(ap), 9).alias("average_precision"))
