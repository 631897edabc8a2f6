"""Loading, feature and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.detection import rounded
from catalog.graphs import vectors
from catalog.injection import num_nodes, with_msg
from catalog.registry import register
from catalog.sql import BIP, BIP_S, UG
from tgraph.functions import arrays as ar
from tgraph.functions import scores as sc
from tgraph.functions.text import STOP_WORDS
from tgraph.operators import features as ft
from tgraph.operators import graphstats as gs
from tgraph.operators import inject as ij
from tgraph.operators import neighbors as nb
from tgraph.operators import scoring as so
from tgraph.operators.metrics import compute_metrics
from tgraph.plans import base
from tgraph.plans.graph import TemporalGraph
from tgraph.plans.steps import clean
from tgraph.sources import readers as rd
from tgraph.sources import writers as wr

QUERIES, ORACLE, query = register()


# --- loading and reshaping ---------------------------------------------------

LONG = """
lf AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'l_discount' AS feature_id, l_discount AS value FROM lineitem
       UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_tax', l_tax FROM lineitem)"""


def long_items(spark, sf):
    items = base.table(spark, sf, "lineitem").withColumn("edge_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rd.long_features(items, ["edge_id"], ["l_discount", "l_quantity", "l_tax"])


@query("unpivot_features", f"""
WITH {LONG} SELECT edge_id, feature_id, count(*) AS n, round(sum(value), 6) AS value FROM lf GROUP BY 1, 2""")
def unpivot_features(spark, sf):
    return long_items(spark, sf).groupBy("edge_id", "feature_id").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")
    )


@query("load_wide_edges", f"""
WITH {LONG}, w AS (SELECT edge_id, max(value) FILTER (feature_id = 'l_discount') AS d, max(value) FILTER (feature_id = 'l_quantity') AS q, max(value) FILTER (feature_id = 'l_tax') AS x FROM lf GROUP BY 1),
e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, o_custkey AS src, l_suppkey AS tgt, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT edge_id, count(*) AS n, min(src) AS src, min(tgt) AS tgt, max(label) AS label, max(d) AS feat_l_discount_num, max(q) AS feat_l_quantity_num, max(x) AS feat_l_tax_num FROM e LEFT JOIN w USING (edge_id) GROUP BY 1""")
def load_wide_edges(spark, sf):
    o, items = base.table(spark, sf, "orders"), base.table(spark, sf, "lineitem")
    e = o.join(items, o.o_orderkey == items.l_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("o_custkey").alias("src"),
        F.col("l_suppkey").alias("tgt"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    # keys repeat in the test data, so the largest value of each is kept
    long = long_items(spark, sf).groupBy("edge_id", "feature_id").agg(F.max("value").alias("value"))
    wide = rd.pivot_features(long, "edge_id", "num")
    out = rd.join_features(e, [wide], "edge_id")
    features = [c for c in out.columns if c.startswith("feat_")]
    return out.groupBy("edge_id").agg(
        F.count("*").alias("n"), F.min("src").alias("src"), F.min("tgt").alias("tgt"), F.max("label").alias("label"),
        *[F.max(c).alias(c) for c in features],
    )


@query("clean_graph", """
WITH r AS (SELECT event_id AS edge_id, user_id AS src, (user_id * 7 + event_id % 13) % 50 AS tgt, epoch_us(ts) AS t FROM events),
c AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, t, min(edge_id) AS edge_id FROM r WHERE src <> tgt GROUP BY 1, 2, 3),
n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT src AS v FROM c UNION SELECT tgt FROM c)),
q AS (SELECT quantile_cont(t, 0.5) AS a, quantile_cont(t, 0.75) AS b FROM c)
SELECT edge_id, x.i AS src, y.i AS tgt, t, CASE WHEN t <= a THEN 'train' WHEN t <= b THEN 'val' ELSE 'test' END AS split
FROM c JOIN n x ON x.v = c.src JOIN n y ON y.v = c.tgt, q""")
def clean_graph(spark, sf):
    raw = base.table(spark, sf, "events").select(
        F.col("event_id").alias("edge_id"), F.col("user_id").alias("src"),
        F.pmod(F.col("user_id") * 7 + F.col("event_id") % 13, F.lit(50)).alias("tgt"), F.col("ts").alias("t"),
    )
    return clean(TemporalGraph(raw)).edges.select("edge_id", "src", "tgt", "t", "split")


@query("describe_graph", f"""
WITH {BIP_S} SELECT count(*) AS num_edges, max(greatest(src, tgt)) + 1 AS num_nodes, min(t) AS t_min, max(t) AS t_max,
  count(*) FILTER (split = 'train') AS train_edges, count(*) FILTER (split = 'val') AS val_edges, count(*) FILTER (split = 'test') AS test_edges,
  count(*) FILTER (label <> 0) AS anomalous_edges FROM bs""")
def describe_graph(spark, sf):
    return TemporalGraph(base.bip_split(spark, sf)).describe()


@query("packed_graph", f"""
WITH {BIP_S} SELECT edge_pos AS edge_id, src, tgt, t, label, split, 1.0::DOUBLE AS w, qty AS msg_0, round(disc, 9) AS msg_1 FROM bs""")
def packed_graph(spark, sf):
    e = base.bip_split(spark, sf).withColumnsRenamed({"edge_pos": "edge_id", "qty": "feat_0", "disc": "feat_1"})
    p = wr.pack_graph(TemporalGraph(e)).edges
    return p.select(
        "edge_id", "src", "tgt", "t", "label", "split", "w",
        F.get("msg", F.lit(0)).alias("msg_0"), F.round(F.get("msg", F.lit(1)), 9).alias("msg_1"),
    )


@query("distinct_counts", f"""
WITH {BIP_S} SELECT count(DISTINCT src) AS sources, count(DISTINCT tgt) AS targets, count(DISTINCT split) AS splits, count(DISTINCT label) AS edge_types FROM bs""")
def distinct_counts(spark, sf):
    return base.bip_split(spark, sf).agg(
        F.countDistinct("src").alias("sources"), F.countDistinct("tgt").alias("targets"),
        F.countDistinct("split").alias("splits"), F.countDistinct("label").alias("edge_types"),
    )


# --- features ------------------------------------------------------------------

FIT = BIP_S + """,
f AS (SELECT avg(qty) AS mq, stddev_samp(qty) AS sq, avg(disc) AS md, stddev_samp(disc) AS sd, min(qty) AS aq, max(qty) AS bq, min(disc) AS ad, max(disc) AS bd FROM bs WHERE split = 'train')"""


def feature_rows(spark, sf):
    return base.bip_split(spark, sf).select("edge_pos", "split", "qty", "disc")


@query("standard_scale", f"WITH {FIT} SELECT edge_pos, round((qty - mq) / sq, 7) AS qty, round((disc - md) / sd, 7) AS disc FROM bs, f")
def standard_scale(spark, sf):
    e = feature_rows(spark, sf)
    (s,) = ft.fit_on_train(e, [(ft.StandardScaler(), ["qty", "disc"])])
    return rounded(s.transform(e).drop("split"), 7)


@query("minmax_scale", f"WITH {FIT} SELECT edge_pos, round((qty - aq) / (bq - aq) * 2 + 1, 7) AS qty, round((disc - ad) / (bd - ad) * 2 + 1, 7) AS disc FROM bs, f")
def minmax_scale(spark, sf):
    e = feature_rows(spark, sf)
    (s,) = ft.fit_on_train(e, [(ft.MinMaxScaler(1.0, 3.0), ["qty", "disc"])])
    return rounded(s.transform(e).drop("split"), 7)


@query("inverse_scale", f"WITH {BIP} SELECT edge_pos, round(qty, 6) AS qty, round(disc, 6) AS disc FROM bip")
def inverse_scale(spark, sf):
    e = feature_rows(spark, sf)
    for norm in (ft.StandardScaler(), ft.MinMaxScaler(-1.0, 1.0)):
        (s,) = ft.fit_on_train(e, [(norm, ["qty", "disc"])])
        e = s.inverse_transform(s.transform(e))
    return rounded(e.drop("split"), 6)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = f"""
tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM documents),
ct AS (SELECT doc_id, word, count(*) AS tf FROM tk WHERE word NOT IN ({_STOP}) GROUP BY 1, 2),
vo AS (SELECT word, sum(tf) AS total, count(*) AS df FROM ct GROUP BY 1 ORDER BY total DESC, word LIMIT 64)"""


def word_values(spark, sf, kind):
    docs = base.table(spark, sf, "documents").select("doc_id", "text")
    v = ft.TextVectorizer(kind).fit(docs, ["text"])
    wide = v.transform(docs)
    names = [c for c in wide.columns if c != "doc_id"]
    long = wide.unpivot(["doc_id"], names, "word", "value").filter("value > 0")
    return long.withColumn("word", F.substring_index("word", f"text_{kind}_", -1))


@query("bow", f"WITH {WORDS} SELECT doc_id, word, tf::DOUBLE AS value FROM ct JOIN vo USING (word)")
def bow(spark, sf):
    return word_values(spark, sf, "bow")


@query("tfidf", f"""
WITH {WORDS}, x AS (SELECT doc_id, word, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS v FROM ct JOIN vo USING (word))
SELECT doc_id, word, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 8) AS value FROM x""")
def tfidf(spark, sf):
    return rounded(word_values(spark, sf, "tfidf"), 8)


ALL_WORDS = WORDS.replace(" ORDER BY total DESC, word LIMIT 64", "")


def all_word_values(spark, sf, kind):
    """Every word of every document: the vocabulary has no bound and stays a table."""
    docs = base.table(spark, sf, "documents").select("doc_id", "text")
    out = ft.TextVectorizer(kind, None).fit(docs, ["text"]).transform(docs)
    return out.select("doc_id", F.explode(f"text_{kind}").alias("word", "value"))


@query("bow_all_words", f"WITH {ALL_WORDS} SELECT doc_id, word, tf::DOUBLE AS value FROM ct JOIN vo USING (word)")
def bow_all_words(spark, sf):
    return all_word_values(spark, sf, "bow")


@query("tfidf_all_words", f"""
WITH {ALL_WORDS}, x AS (SELECT doc_id, word, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS v FROM ct JOIN vo USING (word))
SELECT doc_id, word, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 8) AS value FROM x""")
def tfidf_all_words(spark, sf):
    return rounded(all_word_values(spark, sf, "tfidf"), 8)


@query("padded_batch", f"""
WITH {UG}, x AS (SELECT src AS node, tgt AS nbr, t, edge_pos AS eid FROM ug UNION ALL SELECT tgt, src, t, edge_pos FROM ug),
q AS (SELECT edge_pos * 2 AS qid, src AS node, t FROM ug UNION ALL SELECT edge_pos * 2 + 1, tgt, t FROM ug),
j AS (SELECT qid, nbr, row_number() OVER (PARTITION BY qid ORDER BY x.t DESC, eid DESC, nbr DESC) AS rn FROM q JOIN x ON q.node = x.node AND x.t < q.t)
SELECT qid, least(count(*), 4) AS real_slots, CAST(coalesce(max(nbr) FILTER (rn = 4), -1) AS BIGINT) AS slot_4 FROM j GROUP BY 1""")
def padded_batch(spark, sf):
    e = base.ugraph(spark, sf)
    r = nb.recent_neighbors(nb.ranked_incidence(e), nb.edge_queries(e), 4)
    lists = r.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", "nbr"))).alias("l"))
    ids = F.transform("l", lambda x: x["nbr"])
    out = lists.select("qid", ar.pad(ids, 4, F.lit(-1).cast("bigint")).alias("ids"), ar.pad_mask("l", 4).alias("mask"))
    return out.select(
        "qid", F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("real_slots"),
        F.get("ids", F.lit(3)).alias("slot_4"),
    )


# --- scores --------------------------------------------------------------------

VEC = UG + ", v AS (SELECT vec_id AS node, embedding::DOUBLE[] AS h FROM embeddings), e AS (SELECT edge_pos, t, src, tgt, a.h AS x, b.h AS y FROM ug JOIN v a ON a.node = src JOIN v b ON b.node = tgt)"


@query("dot_score", f"WITH {VEC} SELECT edge_pos, round(1 - 1 / (1 + exp(-list_dot_product(x, y))), 7) AS score FROM e")
def dot_score(spark, sf):
    out = so.dot_scores(base.ugraph(spark, sf), vectors(spark, sf))
    return rounded(out.select("edge_pos", "score"), 7)


@query("quadratic_score", f"""
WITH {VEC}, m AS (SELECT edge_pos, list_transform(list_zip(x, y), lambda z: 0.5 * z[1] + 0.25 * z[2]) AS m FROM e)
SELECT edge_pos, round(1 / (1 + exp(-(0.1::DOUBLE * list_dot_product(m, m) - 0.3::DOUBLE))), 7) AS score FROM m""")
def quadratic_score(spark, sf):
    out = so.quadratic_scores(base.ugraph(spark, sf), vectors(spark, sf), [0.5] * 64, [0.25] * 64, 0.1, 0.3)
    return rounded(out.select("edge_pos", "score"), 7)


@query("edge_operators", f"""
WITH {VEC} SELECT edge_pos, round(x[1] * y[1], 7) AS hadamard_first, round((x[64] + y[64]) / 2, 7) AS average_last, round(x[2] + y[2], 7) AS add_second,
  round(1 - list_cosine_similarity(x, y), 7) AS cosine_distance, round(list_distance(x, y), 6) AS l2_distance FROM e""")
def edge_operators(spark, sf):
    e = so.with_endpoint_vectors(base.ugraph(spark, sf), vectors(spark, sf))
    return rounded(e.select(
        "edge_pos", F.get(ar.hadamard("h_src", "h_tgt"), F.lit(0)).alias("hadamard_first"),
        F.get(ar.average("h_src", "h_tgt"), F.lit(63)).alias("average_last"),
        F.get(ar.add("h_src", "h_tgt"), F.lit(1)).alias("add_second"),
        ar.cosine_distance("h_src", "h_tgt").alias("cosine_distance"),
        F.round(ar.l2_distance("h_src", "h_tgt"), 6).alias("l2_distance"),
    ), 7)


@query("drift_score", f"""
WITH {VEC}, s AS (SELECT edge_pos, x, y, list_transform(list_zip(x, y), lambda z: (z[1] + z[2]) / 2) AS m FROM e)
SELECT edge_pos, round((2 - list_cosine_similarity(x, y) - list_cosine_similarity(m, x)) / 4, 7) AS score,
  round((1 - list_cosine_similarity(x, y)) / 2, 7) AS drift, round((1 - list_cosine_similarity(m, x)) / 2, 7) AS recovery FROM s""")
def drift_score(spark, sf):
    e = so.with_endpoint_vectors(base.ugraph(spark, sf), vectors(spark, sf))
    s = e.select("edge_pos", F.col("h_src").alias("now"), F.col("h_tgt").alias("before"), ar.average("h_src", "h_tgt").alias("seen"))
    out = so.drift_scores(s)
    return rounded(out.select(
        "edge_pos", "score", sc.drift_score("now", "before", "seen", "drift").alias("drift"),
        sc.drift_score("now", "before", "seen", "recovery").alias("recovery"),
    ), 7)


MEMORY = BIP_S + """,
me AS (SELECT t, disc FROM bs WHERE split = 'train' AND label <= 0 ORDER BY t DESC, edge_pos DESC LIMIT 500)"""


def memory(spark, sf):
    e = base.bip_split(spark, sf).select("edge_pos", "t", "split", "label", F.col("disc").alias("score"))
    return e, so.rolling_memory(e.filter(F.col("split") == "train"), 500)


@query("rolling_memory", f"WITH {MEMORY} SELECT t, round(disc, 9) AS score FROM me")
def rolling_memory(spark, sf):
    return rounded(memory(spark, sf)[1].select("t", "score"))


@query("deviation_score", f"""
WITH {MEMORY}, w AS (SELECT q.t, 1 / (ln(abs(q.t - me.t) / 1000000.0::DOUBLE / 3600.0::DOUBLE + 1) + 1) AS w, disc FROM (SELECT DISTINCT t FROM bs WHERE split = 'test') q, me),
m AS (SELECT t, sum(w * disc) / sum(w) AS mu, sum(w * disc * disc) / sum(w) AS sq FROM w GROUP BY 1)
SELECT edge_pos, round((disc - mu) / (sqrt(sq - mu * mu) + 1e-6), 5) AS deviation FROM bs JOIN m ON m.t = bs.t WHERE split = 'test'""")
def deviation_score(spark, sf):
    e, mem = memory(spark, sf)
    out = so.deviation_scores(e.filter(F.col("split") == "test"), mem, 1e6)
    return rounded(out.select("edge_pos", "deviation"), 5)


@query("deviation_bucket", f"""
WITH {MEMORY}, z AS (SELECT edge_pos, (disc - (SELECT avg(disc) FROM me)) / (SELECT stddev_samp(disc) FROM me) AS z FROM bs WHERE split = 'test')
SELECT edge_pos, CAST((z > -3)::INT + (z > -2)::INT + (z > -1)::INT + (z > 1)::INT + (z > 2)::INT + (z > 3)::INT AS INTEGER) AS bucket FROM z""")
def deviation_bucket(spark, sf):
    e, mem = memory(spark, sf)
    return so.plain_deviation(e.filter(F.col("split") == "test"), mem).select("edge_pos", "bucket")


@query("score_scaling", f"""
WITH {BIP_S}, r AS (SELECT split, min(disc) AS a, max(disc) AS b FROM bs GROUP BY 1)
SELECT edge_pos, split, round(CASE WHEN b > a THEN (disc - a) / (b - a) ELSE 0.5 END, 7) AS score FROM bs JOIN r USING (split)""")
def score_scaling(spark, sf):
    e = base.bip_split(spark, sf).select("edge_pos", "split", F.col("disc").alias("score"))
    return rounded(so.min_max_scores(e, ["split"]), 7)


@query("label_rectify", f"WITH {BIP} SELECT edge_pos, round(0.9::DOUBLE * label + (1 - 0.9::DOUBLE) * disc * 10, 7) AS label FROM bip")
def label_rectify(spark, sf):
    e = base.bip(spark, sf).select("edge_pos", "label", (F.col("disc") * 10).alias("predicted"))
    return rounded(so.rectify_labels(e).select("edge_pos", "label"), 7)


@query("kmeans_score")
def kmeans_score(spark, sf):
    e = so.edge_vectors(base.ugraph_split(spark, sf), vectors(spark, sf))
    return so.min_max_scores(so.kmeans_scores(e, "edge_vec", 5)).select("edge_pos", "split", "score")


@query("linear_decoder")
def linear_decoder(spark, sf):
    """Decoder on concatenated end vectors; metrics of the test split."""
    e = so.edge_vectors(base.ugraph_split(spark, sf), vectors(spark, sf), "concat")
    e = e.withColumn("label", ((F.col("src") + F.col("tgt")) % 5 == 0).cast("int"))
    d = so.LinearDecoder().fit(e.filter(F.col("split") == "train"))
    return compute_metrics(d.transform(e.filter(F.col("split") == "test")))


@query("heuristic_detector")
def heuristic_detector(spark, sf):
    """Injected anomalies found from link heuristics; metrics of the test split."""
    e = with_msg(base.bip_split(spark, sf)).select("src", "tgt", "t", "edge_pos", "split", "msg")
    new, _ = ij.inject(e, "random", {"val": 0.1, "test": 0.1}, num_nodes(e), seed="hd", msg_size=3)
    merged = ij.merge_injected(e, new)
    history = e.filter(F.col("split") == "train")
    adj = gs.symmetric_adjacency(history)
    detector = so.HeuristicDetector().fit(merged.filter(F.col("split") == "val"), history, adj)
    scored = so.score_snapshots(merged, lambda df: detector.transform(df, history, adj))
    return compute_metrics(scored)
