"""Readers and writers: a given table is written in a format, read back and compared by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import register
from catalog.sql import BIP_S, UG, UG_S
from tgraph.operators import structure as st
from tgraph.plans import base
from tgraph.plans.graph import TemporalGraph
from tgraph.session import scratch_dir
from tgraph.sources import readers as rd
from tgraph.sources import writers as wr

QUERIES, ORACLE, query = register()


def folder(spark: SparkSession) -> str:
    """A new folder in the job's shared scratch folder."""
    return f"{scratch_dir(spark)}/tgraph/files-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return base.table(spark, sf, "events").select(
        F.col("event_id"), F.col("user_id").alias("src"), F.pmod(F.col("event_id") * 7, F.lit(50)).alias("tgt"), base.micros("ts").alias("t"), "value", "event_type"
    )


EV = """
ev AS (SELECT event_id, user_id AS src, (event_id * 7) % 50 AS tgt, epoch_us(ts) AS t, value, event_type FROM events)
"""


@query("read_csv_edges", f"WITH {EV} SELECT src, tgt, t, count(*) AS n FROM ev GROUP BY ALL")
def read_csv_edges(spark, sf):
    """Headerless gzipped edges, of which three of four columns are read."""
    path = folder(spark)
    events(spark, sf).select("src", "tgt", F.lit(1).alias("w"), "t").write.csv(path, compression="gzip")
    e = rd.read_edge_list(spark, path, "a bigint, b bigint, w int, t bigint", {"a": "src", "b": "tgt", "t": "t"})
    return e.groupBy("src", "tgt", "t").agg(F.count("*").alias("n"))


@query("read_space_edges", f"WITH {EV} SELECT event_id, src, tgt, CASE WHEN event_id % 10 <> 0 THEN t ELSE -1 END AS t FROM ev")
def read_space_edges(spark, sf):
    """Blank-separated edges with comment lines and a marker for missing times."""
    path = folder(spark)
    time = F.when(F.col("event_id") % 10 == 0, "-").otherwise(F.col("t").cast("string"))
    line = F.concat_ws(" ", "event_id", "src", "tgt", time)
    noted = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("% preamble\n"), line)).otherwise(line)
    events(spark, sf).select(noted).write.text(path)
    names = {c: c for c in ("event_id", "src", "tgt", "t")}
    e = rd.read_edge_list(spark, path, "event_id bigint, src bigint, tgt bigint, t bigint", names, sep=" ", comment="%", null="-")
    return e.withColumn("t", F.coalesce("t", F.lit(-1)))


@query("read_interactions", """
SELECT o_custkey AS src, l_suppkey AS tgt, CAST(epoch_us(o_orderdate) AS DOUBLE) AS t, CAST(l_linenumber % 2 AS INTEGER) AS label, CAST(l_quantity AS DOUBLE) AS f0,
  CASE WHEN l_linenumber <> 3 THEN CAST(l_discount AS DOUBLE) END AS f1, count(*) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def read_interactions(spark, sf):
    """User, item, time, label and features with a marker for missing values."""
    path = folder(spark)
    o, i = base.table(spark, sf, "orders"), base.table(spark, sf, "lineitem")
    rows = o.join(i, o.o_orderkey == i.l_orderkey).select(
        "o_custkey", "l_suppkey", base.micros("o_orderdate").cast("double").alias("t"), F.col("l_linenumber") % 2,
        F.col("l_quantity").cast("double"), F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_discount").cast("double").cast("string")),
    )
    rows.toDF("user", "item", "ts", "label", "a", "b").write.csv(path, header=True)
    e = rd.read_interactions(spark, path, 2)
    return e.select("src", "tgt", "t", "label", F.col("msg")[0].alias("f0"), F.col("msg")[1].alias("f1")).groupBy("src", "tgt", "t", "label", "f0", "f1").agg(F.count("*").alias("n"))


@query("read_actions", f"""
WITH {EV} SELECT event_id AS edge_id, src, tgt, CAST(t AS DOUBLE) AS t, CAST(value AS DOUBLE) AS feat_0_num, CAST(src AS DOUBLE) AS feat_1_num,
  CAST(tgt AS DOUBLE) AS feat_2_num, CAST(event_id % 3 AS DOUBLE) AS feat_3_num, CAST(CASE WHEN event_id % 4 <> 0 THEN event_id % 2 ELSE -1 END AS INTEGER) AS label FROM ev""")
def read_actions(spark, sf):
    """Actions, features and labels as three tab-separated tables."""
    path, e = folder(spark), events(spark, sf)
    tsv = {"sep": "\t", "header": True}
    e.select("event_id", "src", "tgt", F.col("t").cast("double")).write.csv(f"{path}/actions.tsv", **tsv)
    e.select("event_id", "value", "src", "tgt", F.col("event_id") % 3).toDF("id", "a", "b", "c", "d").write.csv(f"{path}/action_features.tsv", **tsv)
    e.filter("event_id % 4 <> 0").select("event_id", (F.col("event_id") % 2).alias("l")).write.csv(f"{path}/action_labels.tsv", **tsv)
    return rd.read_actions(spark, path).withColumn("label", F.coalesce("label", F.lit(-1)))


@query("read_reviews", """
SELECT d.doc_id AS src, CAST(n_chars AS BIGINT) AS tgt, CAST(make_date(2010 + CAST(d.doc_id % 12 AS INT), 1 + CAST(d.doc_id % 12 AS INT), 1 + CAST(d.doc_id % 28 AS INT)) AS VARCHAR) AS t,
  CASE WHEN d.doc_id % 2 = 0 THEN 1 ELSE 0 END AS label, CAST(d.doc_id % 5 AS DOUBLE) AS rating, md5(text) AS text_md5
FROM documents d""")
def read_reviews(spark, sf):
    """Reviews with any texts: commas, quotes, backslashes, line breaks, empty and absent ones."""
    path = folder(spark)
    d = base.table(spark, sf, "documents")
    month = lambda n: F.pmod("doc_id", F.lit(n))
    date = F.make_date((month(12) + 2010).cast("int"), (month(12) + 1).cast("int"), (month(28) + 1).cast("int"))
    label = F.when(F.col("doc_id") % 2 == 0, -1).otherwise(1)
    rows = d.select("doc_id", "n_chars", (F.col("doc_id") % 5).cast("double").alias("rating"), label.alias("label"), date.cast("string").alias("date"), "text")
    rows.write.csv(path, quoteAll=True, **rd.REVIEW_CSV)
    r = rd.read_reviews(spark, path)
    return r.select("src", "tgt", F.col("t").cast("string").alias("t"), "label", "rating", F.md5("text").alias("text_md5"))


@query("read_ndjson", """
SELECT CAST(o_totalprice AS DOUBLE) AS rating, o_orderpriority AS title, CAST(o_custkey AS VARCHAR) AS user_id, epoch_us(o_orderdate) AS timestamp,
  o_orderstatus = 'O' AS verified_purchase FROM orders""")
def read_ndjson(spark, sf):
    """One object per line, gzipped; absent fields are null."""
    path = folder(spark)
    o = base.table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("double").alias("rating"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("user_id"),
        base.micros("o_orderdate").alias("timestamp"), F.when(F.col("o_orderstatus") == "O", True).alias("verified_purchase"),
    )
    o.write.json(path, compression="gzip")
    return rd.read_ndjson(spark, path).select("rating", "title", "user_id", "timestamp", F.coalesce("verified_purchase", F.lit(False)).alias("verified_purchase"))


def dataset(spark: SparkSession, sf: str) -> TemporalGraph:
    """Orders as edges with long features and labels, customers and suppliers as nodes; written and loaded."""
    path = folder(spark)
    e = events(spark, sf).withColumnsRenamed({"event_id": "edge_id", "t": "timestamp"})
    long = rd.long_features(e.withColumn("one", F.col("src") + 0.5), ["edge_id"], ["value", "one"]).filter("value is not null")
    nodes = st.nodes_of(e)
    wr.write_dataset(
        {
            "edges": e.select("edge_id", "src", "tgt", "timestamp"), "edge_features_num": long,
            "edge_labels": e.filter("edge_id % 3 = 0").select("edge_id", (F.col("edge_id") % 2).cast("int").alias("label")),
            "node_types": nodes.filter("node_id % 2 = 0").withColumn("node_type", (F.col("node_id") % 3).cast("int")),
            "node_labels": nodes.withColumn("label", (F.col("node_id") % 5).cast("int")),
        },
        path, "events",
    )
    return rd.load_dataset(spark, path, "events")


@query("load_dataset_edges", f"""
WITH {EV} SELECT event_id AS edge_id, src, tgt, t AS timestamp, CAST(src + 0.5 AS DOUBLE) AS feat_one_num, CAST(value AS DOUBLE) AS feat_value_num,
  CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 2 ELSE -1 END AS INTEGER) AS label FROM ev""")
def load_dataset_edges(spark, sf):
    return dataset(spark, sf).edges.select("edge_id", "src", "tgt", "timestamp", "feat_one_num", "feat_value_num", F.coalesce("label", F.lit(-1)).alias("label"))


@query("load_dataset_nodes", f"""
WITH {EV} SELECT DISTINCT n AS node_id, CAST(n % 3 AS INTEGER) AS node_type, CAST(n % 5 AS INTEGER) AS label
FROM (SELECT src AS n FROM ev UNION ALL SELECT tgt FROM ev) WHERE n % 2 = 0""")
def load_dataset_nodes(spark, sf):
    return dataset(spark, sf).nodes.select("node_id", "node_type", "label")


def custom_files(spark: SparkSession, sf: str) -> str:
    """train.csv and test.csv of the split interaction log; only test has labels."""
    path = folder(spark)
    e = base.bip_split(spark, sf).select("src", "tgt", "t", "label", "qty", "split")
    e.filter("split = 'train'").select("src", "tgt", "t", F.col("qty").cast("double").alias("qty")).write.csv(f"{path}/train.csv", header=True)
    e.filter("split <> 'train'").select("src", "tgt", "t", "label").write.csv(f"{path}/test.csv", header=True)
    return path


CUSTOM = """
cu AS (
  SELECT src, tgt, t, CASE WHEN split = 'train' THEN 0 ELSE label END AS label, CASE WHEN split = 'train' THEN CAST(qty AS DOUBLE) END AS qty,
    CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS split FROM bs),
cp AS (SELECT *, row_number() OVER (ORDER BY split = 'test', t, src, tgt) - 1 AS edge_id FROM cu)
"""


@query("load_custom", f"WITH {BIP_S}, {CUSTOM} SELECT edge_id, src, tgt, t, CAST(label AS INTEGER) AS label, qty, split FROM cp")
def load_custom(spark, sf):
    e = rd.load_custom_dataset(spark, custom_files(spark, sf)).edges
    return e.select("edge_id", F.col("src").cast("bigint").alias("src"), F.col("tgt").cast("bigint").alias("tgt"), F.col("t").cast("bigint").alias("t"), "label", "qty", "split")


@query("load_flipped", f"""
WITH {BIP_S}, {CUSTOM}, nd AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id FROM (SELECT DISTINCT unnest([src, tgt]) AS n FROM cp)),
lo AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY edge_id) - 1 AS p FROM cp)
SELECT edge_id, a.id AS src, b.id AS tgt, CAST(1 - label AS INTEGER) AS label,
  p // 500 + CASE WHEN split = 'test' THEN (SELECT max(p) // 500 + 1 FROM lo WHERE split = 'train') ELSE 0 END AS snapshot_id
FROM lo JOIN nd a ON a.n = src JOIN nd b ON b.n = tgt""")
def load_flipped(spark, sf):
    e = rd.load_flipped(spark, custom_files(spark, sf), 500).edges
    return e.select("edge_id", "src", "tgt", F.col("label").cast("int").alias("label"), "snapshot_id")


@query("preprocess_edges", f"""
WITH {EV}, ca AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, min(t) AS t FROM ev WHERE src <> tgt GROUP BY 1, 2),
nd AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id FROM (SELECT DISTINCT unnest([a, b]) AS n FROM ca))
SELECT row_number() OVER (ORDER BY t, a, b) - 1 AS edge_id, x.id AS src, y.id AS tgt, t FROM ca JOIN nd x ON x.n = a JOIN nd y ON y.n = b""")
def preprocess_edges(spark, sf):
    """Parse, canonical order, first of repeats, dense ids and time order in one."""
    path = folder(spark)
    events(spark, sf).select("src", "tgt", "t").write.csv(path)
    names = {c: c for c in ("src", "tgt", "t")}
    e = rd.preprocess(rd.read_edge_list(spark, path, "src bigint, tgt bigint, t bigint", names))
    return e.select("edge_id", "src", "tgt", "t")


@query("read_provenance", f"""
WITH {EV}, pr AS (SELECT *, 'p' || src AS a, 'f' || tgt AS b FROM ev),
nd AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS id FROM (SELECT DISTINCT unnest([a, b]) AS n FROM pr)),
na AS (SELECT n, id, CASE WHEN id % 2 = 0 AND left(n, 1) = 'p' THEN 'process' END AS type FROM nd)
SELECT row_number() OVER (ORDER BY t, event_id % 100, CAST(event_id AS VARCHAR)) - 1 AS edge_id, x.id AS src, y.id AS tgt, t, event_type AS kind,
  CASE WHEN left(a, 1) = 'p' AND CAST(substr(a, 2) AS INT) % 2 = 0 THEN 'process' END AS src_type
FROM pr JOIN na x ON x.n = a JOIN na y ON y.n = b""")
def read_provenance(spark, sf):
    """Edges of 15 columns and nodes with attributes, some of them without."""
    path = folder(spark)
    e = events(spark, sf).select("event_id", F.concat(F.lit("p"), "src").alias("a"), F.concat(F.lit("f"), "tgt").alias("b"), "event_type", "t")
    blank = F.lit(None).cast("string")
    wide = e.select("event_id", "a", "b", "event_type", "t", F.lit(1), *[blank] * 3, F.col("event_id") % 100, F.lit(0), F.lit(1.0), *[blank] * 3)
    wide.toDF(*[f"c{i}" for i in range(15)]).write.csv(f"{path}/edges", header=True)
    n = e.select(F.col("a").alias("uuid")).distinct().filter(F.substring("a", 2, 20).cast("bigint") % 2 == 0)
    n.select("uuid", F.lit("process"), F.concat(F.lit("n"), "uuid"), blank).toDF("uuid", "type", "name", "command").write.csv(f"{path}/nodes", header=True)
    g = rd.read_provenance(spark, f"{path}/edges", f"{path}/nodes")
    types = g.nodes.select(F.col("node_id").alias("src"), F.col("type").alias("src_type"))
    return g.edges.join(types, "src").select("edge_id", "src", "tgt", "t", "kind", "src_type")


@query("assemble_arrays", f"""
WITH {EV}, ti AS (SELECT n, min(t) AS t0 FROM (SELECT src AS n, t FROM ev UNION ALL SELECT tgt, t FROM ev) GROUP BY 1)
SELECT event_id AS edge_id, src, tgt, event_type AS edge_type, greatest(a.t0, b.t0) AS t FROM ev JOIN ti a ON a.n = src JOIN ti b ON b.n = tgt""")
def assemble_arrays(spark, sf):
    """Node features, labels and times with typed edges: an edge is as late as its later end."""
    e = events(spark, sf)
    ends = e.select(F.explode(F.array("src", "tgt")).alias("node_id"), "t", "value")
    times = ends.groupBy("node_id").agg(F.min("t").alias("timestamp"))
    nodes = ends.groupBy("node_id").agg(F.max("value").alias("x"))
    labels = times.select("node_id", (F.col("node_id") % 2).alias("label"))
    edges = e.select(F.col("event_id").alias("edge_id"), "src", "tgt", F.col("event_type").alias("edge_type"))
    g = rd.assemble_arrays(nodes, labels, times, edges)
    return g.edges.select("edge_id", "src", "tgt", "edge_type", "t")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as published results: one row per priority, status and year."""
    o = base.table(spark, sf, "orders")
    keys = [F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("dataset"), F.lit("burst").alias("anom_type"), (F.month("o_orderdate") / 100).alias("anom_ratio")]
    best = F.max("o_totalprice").cast("double")
    return o.groupBy(*keys).agg(F.lit(0.5).alias("anom_duration"), F.when(best > 300_000, best).alias("auprc"), F.min("o_totalprice").cast("double").alias("rocauc"))


RES = """
re AS (
  SELECT o_orderpriority AS method, o_orderstatus AS dataset, 'burst' AS anom_type, month(o_orderdate) / 100.0::DOUBLE AS anom_ratio, 0.5::DOUBLE AS anom_duration,
    CASE WHEN max(o_totalprice) > 300000 THEN max(o_totalprice)::DOUBLE END AS auprc, min(o_totalprice)::DOUBLE AS rocauc
  FROM orders GROUP BY 1, 2, 3, 4)
"""


@query("read_results", f"WITH {RES} SELECT * FROM re")
def read_results(spark, sf):
    """Result tables of all methods, one folder each, read as one."""
    path = folder(spark)
    results(spark, sf).withColumn("of", F.substring("method", 1, 1)).write.partitionBy("of").csv(path, header=True)
    return rd.read_results(spark, f"{path}/of=*")


@query("read_benchmarks", f"WITH {RES} SELECT method, dataset, anom_ratio, rocauc FROM re")
def read_benchmarks(spark, sf):
    path = folder(spark)
    wr.write_benchmark(results(spark, sf).select("method", "dataset", "anom_ratio", "rocauc"), path)
    return rd.read_benchmarks(spark, f"{path}/csv", "method string, dataset string, anom_ratio double, rocauc double")


@query("read_run_metrics", f"WITH {RES} SELECT method, dataset, count(*) AS runs, round(sum(rocauc), 4) AS total FROM re GROUP BY 1, 2")
def read_run_metrics(spark, sf):
    """Per-run metric files by method and dataset, and the evaluation's two files."""
    path, r = folder(spark), results(spark, sf)
    wr.write_run_metrics(r, path)
    back = spark.read.json(path).groupBy("method", "dataset").agg(F.count("*").alias("runs"), F.round(F.sum("rocauc"), 4).alias("total"))
    wr.write_evaluation(r, back, f"{path}-evaluation")
    return spark.read.json(f"{path}-evaluation/summary").select("method", "dataset", "runs", "total")


LOG = """
lg AS (
  SELECT event_type || '__log' AS run, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS hour, count(*) AS num_edges, max(value)::DOUBLE AS latency_ms,
    CASE WHEN count(*) > 1 THEN (max(epoch_us(ts)) - min(epoch_us(ts)))::DOUBLE END AS span
  FROM events GROUP BY 1, 2),
ls AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hour) - 1 AS seq FROM lg)
"""


@query("read_sidecars", f"WITH {LOG} SELECT split_part(run, '__', 1) AS method, 'log' AS dataset, seq, latency_ms, num_edges, num_edges / 2.0::DOUBLE AS mean_degree, span FROM ls")
def read_sidecars(spark, sf):
    """Per-run arrays, written in the order of their snapshots."""
    path = folder(spark)
    e = base.table(spark, sf, "events").select(F.concat("event_type", F.lit("__log")).alias("run"), base.micros("ts").alias("t"), "value")
    hour = F.floor(F.col("t") / F.lit(3_600_000_000)).cast("bigint")
    span = F.when(F.count("*") > 1, (F.max("t") - F.min("t")).cast("double"))
    rows = e.groupBy("run", hour.alias("seq")).agg(
        F.max("value").cast("double").alias("latency_ms"), F.count("*").alias("num_edges"), (F.count("*") / 2.0).alias("mean_degree"), span.alias("span")
    )
    wr.write_sidecars(rows, path)
    return rd.read_sidecars(spark, path, multi_line=False)


VAR = f"""
WITH {UG}, gr AS (SELECT src, tgt, t, CASE WHEN edge_pos % 9 = 0 THEN 1 + edge_pos % 4 ELSE 0 END AS group_id FROM ug)
SELECT count(*) AS num_edges, max(tgt) + 1 AS num_nodes, max(group_id) AS anomaly_groups, sum((group_id > 0)::INT)::BIGINT AS anomalous_edges, 'burst' AS type FROM gr"""


def variant(spark: SparkSession, sf: str) -> TemporalGraph:
    group = F.when(F.col("edge_pos") % 9 == 0, F.col("edge_pos") % 4 + 1).otherwise(0)
    return TemporalGraph(base.ugraph(spark, sf).withColumn("group_id", group), metadata={"type": "burst"})


@query("load_variant", VAR)
def load_variant(spark, sf):
    """A variant built once, saved with its summary, and loaded."""
    path, name = folder(spark), wr.variant_name("burst", {"test": 0.1}, "small")
    wr.load_variant(spark, path, "events", name, lambda: variant(spark, sf))
    g = wr.load_variant(spark, path, "events", name)
    return wr.variant_metadata(g.edges).withColumn("type", F.lit(g.metadata["type"]))


@query("step_cache", VAR)
def step_cache(spark, sf):
    """A step's result kept under the md5 of its parameters; the second call reads it."""
    cache = wr.StepCache(folder(spark))
    cache.run(1, {"rate": 0.1}, spark, lambda: variant(spark, sf))

    def never():
        raise AssertionError("the cache was not used")

    g = cache.run(1, {"rate": 0.1}, spark, never)
    return wr.variant_metadata(g.edges).withColumn("type", F.lit(g.metadata["type"]))


@query("analysis_cache", f"WITH {UG}, nd AS (SELECT DISTINCT unnest([src, tgt]) AS n FROM ug) SELECT n AS node_id, n % 7 AS cluster, (SELECT count(*) FROM ug) AS num_edges FROM nd")
def analysis_cache(spark, sf):
    """Graph statistics and community labels, saved and loaded."""
    path, e = folder(spark), base.ugraph(spark, sf)
    wr.save_analysis(e.agg(F.count("*").alias("num_edges")), st.nodes_of(e).withColumn("cluster", F.col("node_id") % 7), path)
    stats, communities = wr.load_analysis(spark, path)
    return communities.join(F.broadcast(stats))


@query("pack_graph", f"""
WITH {BIP_S} SELECT edge_pos AS edge_id, src, tgt, t, CAST(qty AS DOUBLE) AS m0, round(CAST(price AS DOUBLE), 4) AS m1, label, split, 1.0::DOUBLE AS w FROM bs""")
def pack_graph(spark, sf):
    e = base.bip_split(spark, sf).withColumnsRenamed({"edge_pos": "edge_id", "qty": "feat_a", "price": "feat_b"})
    p = wr.pack_graph(TemporalGraph(e)).edges
    return p.select("edge_id", "src", "tgt", "t", F.col("msg")[0].alias("m0"), F.round(F.col("msg")[1], 4).alias("m1"), "label", "split", "w")


@query("legacy_columns", f"""
WITH {BIP_S}, nd AS (SELECT DISTINCT unnest([src, tgt]) AS n FROM bs)
SELECT edge_pos AS e_id, src AS e_src, tgt AS e_tgt, t AS e_timestamp, label AS e_label, split AS e_split, a.n AS hot FROM bs JOIN nd a ON a.n = src""")
def legacy_columns(spark, sf):
    e = base.bip_split(spark, sf).withColumnRenamed("edge_pos", "edge_id").select("edge_id", "src", "tgt", "t", "label", "split")
    edges, nodes = wr.legacy_columns(TemporalGraph(e))
    return edges.join(nodes, edges.e_src == nodes.n_id).drop("n_id")


@query("split_parts", f"""
WITH {UG_S}, nd AS (SELECT DISTINCT unnest([src, tgt]) AS n FROM us), sp AS (SELECT unnest(['train', 'val', 'test']) AS split)
SELECT split, (SELECT count(*) FROM us WHERE us.split = sp.split) AS edges, (SELECT count(*) FROM nd) AS nodes,
  (SELECT count(*) FROM nd WHERE n % 3 = CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS dynamic_nodes FROM sp""")
def split_parts(spark, sf):
    """Edges and nodes of each split: static nodes are returned whole, dynamic ones by split."""
    e = base.ugraph_split(spark, sf)
    nodes = st.nodes_of(e)
    part = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.pmod("node_id", F.lit(3)) + 1).cast("int"))
    static, dynamic = TemporalGraph(e, nodes), TemporalGraph(e, nodes.withColumn("split", part))
    rows = None
    for split in ("train", "val", "test"):
        counts = [static.split_edges(split).agg(F.count("*").alias("edges")), static.split_nodes(split).agg(F.count("*").alias("nodes")), dynamic.split_nodes(split).agg(F.count("*").alias("dynamic_nodes"))]
        one = counts[0].select(F.lit(split).alias("split"), "edges").join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))
        rows = one if rows is None else rows.union(one)
    return rows


@query("fill_empty", f"""
WITH {UG}, nd AS (SELECT DISTINCT unnest([src, tgt]) AS n FROM ug)
SELECT n AS node, coalesce(tgt, n) AS nbr FROM nd LEFT JOIN (SELECT DISTINCT src, tgt FROM ug) ON src = n""")
def fill_empty(spark, sf):
    """Centres without later neighbours get themselves."""
    e = base.ugraph(spark, sf)
    near = e.select(F.col("src").alias("node"), F.col("tgt").alias("nbr")).distinct()
    return st.fill_empty(st.nodes_of(e, "node"), near, "node", "nbr", "node").select("node", "nbr")


@query("clip_scores", "SELECT doc_id, least(greatest(n_chars / 1000.0::DOUBLE, 0.5), 4.0) AS clipped FROM documents")
def clip_scores(spark, sf):
    from tgraph.functions.scores import clip

    return base.table(spark, sf, "documents").select("doc_id", clip(F.col("n_chars") / 1000.0, F.lit(0.5), F.lit(4.0)).alias("clipped"))
