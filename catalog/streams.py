"""Stream queries: the result after all input must equal the batch operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.sql import BIP_S, UG
from tgraph.plans import base
from tgraph.session import scratch_dir
from tgraph.streaming import operators as op
from tgraph.streaming import replay as rp
from tgraph.streaming import runs as rn

QUERIES, ORACLE, query = register()

SLICES = 3
DAY = 86_400_000_000


def edge_stream(spark, edges, closing=False):
    """``edges`` replayed in slices; ``closing`` adds a last edge years later.

    The closing edge (src -1) moves the watermark past all windows.
    """
    if closing:
        top = edges.agg(F.max("edge_pos").alias("p"), F.max("t").alias("t")).first()
        last = spark.createDataFrame(
            [(-1, -1, top["t"] + 1000 * DAY, top["p"] + 1)], "src bigint, tgt bigint, t bigint, edge_pos bigint"
        )
        edges = edges.unionByName(last)
    path = rp.write_slices(edges, SLICES)
    return rp.read_stream(spark, path, spark.read.parquet(path).schema)


def ug(spark, sf):
    return base.ugraph(spark, sf).select("src", "tgt", "t", "edge_pos")


@query("stream_tumbling", f"""
WITH {UG} SELECT CAST((t // {DAY}) * {DAY} AS BIGINT) AS start, count(*) AS edges, min(t) AS t_min, max(t) AS t_max FROM ug GROUP BY 1""")
def stream_tumbling(spark, sf):
    w = op.tumbling_snapshots(edge_stream(spark, ug(spark, sf), True), "1 day")
    out, _ = rp.run_to_table(w, "append", "tumbling")
    return out.select(F.unix_micros("start").alias("start"), "edges", "t_min", "t_max")


@query("stream_sessions", f"""
WITH {UG}, g AS (SELECT src, t, CASE WHEN t - lag(t) OVER (PARTITION BY src ORDER BY t, edge_pos) < 21600000000 THEN 0 ELSE 1 END AS n, edge_pos FROM ug),
s AS (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY t, edge_pos) AS k FROM g)
SELECT src, count(*) AS edges, min(t) AS t_min, max(t) AS t_max FROM s GROUP BY src, k""")
def stream_sessions(spark, sf):
    s = op.session_runs(edge_stream(spark, ug(spark, sf), True), "6 hours")
    out, _ = rp.run_to_table(s, "append", "sessions")
    return out.drop("batch_id")


LATE = 2 * DAY
BATCHES = 4

ARRIVALS = f"""{UG}, ar AS (SELECT *, edge_pos + CASE WHEN edge_pos % 5 = 0 THEN (SELECT count(*) FROM ug) // 4 ELSE 0 END AS arrival FROM ug),
bt AS (SELECT *, arrival // (SELECT CAST(ceil((max(arrival) + 1) / {BATCHES}.0::DOUBLE) AS BIGINT) FROM ar) AS b FROM ar),
bd AS (SELECT b + 1 AS b, max(max(t)) OVER (ORDER BY b) - {LATE} AS bound FROM bt GROUP BY bt.b),
jd AS (SELECT bt.*, bound IS NOT NULL AND t < bound AS late FROM bt LEFT JOIN bd USING (b))"""


def delayed_runs(spark, sf):
    """Runs of a stream in which each fifth edge arrives a quarter of the table later."""
    e = ug(spark, sf)
    n = e.count()
    e = e.withColumn("arrival", F.col("edge_pos") + F.when(F.col("edge_pos") % 5 == 0, n // 4).otherwise(0))
    path = rp.write_slices(e, BATCHES, "arrival")
    schema = spark.read.parquet(path).schema
    root = f"{scratch_dir(spark)}/tgraph/runs-{uuid.uuid4().hex}"
    query = rn.event_runs(rp.read_stream(spark, path, schema), root, LATE)
    query.awaitTermination()
    rn.finish(spark, root, schema)
    return root, schema


@query("stream_event_runs", f"""
WITH {ARRIVALS}, o AS (SELECT src, t, CASE WHEN src = lag(src) OVER (ORDER BY t, src, edge_pos) THEN 0 ELSE 1 END AS n, edge_pos FROM jd WHERE NOT late),
r AS (SELECT *, sum(n) OVER (ORDER BY t, src, edge_pos) - 1 AS run FROM o)
SELECT run::BIGINT AS run, src, count(*) AS edges, min(t) AS t_min, max(t) AS t_max FROM r GROUP BY run, src""")
def stream_event_runs(spark, sf):
    root, schema = delayed_runs(spark, sf)
    return rn.read_runs(spark, root, schema)


@query("stream_event_late", f"""
WITH {ARRIVALS} SELECT src, tgt, t, edge_pos, b::BIGINT AS batch FROM jd WHERE late""")
def stream_event_late(spark, sf):
    root, schema = delayed_runs(spark, sf)
    return rn.read_late(spark, root, schema).select("src", "tgt", "t", "edge_pos", F.col("batch_id").alias("batch"))


@query("stream_degree", f"""
WITH {UG} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ug UNION ALL SELECT tgt FROM ug) GROUP BY 1""")
def stream_degree(spark, sf):
    out, _ = rp.run_to_table(op.stream_degrees(edge_stream(spark, ug(spark, sf))), "update", "degree")
    return rp.latest(out, ["node"])


HALF = 5.0 * 86_400_000_000


@query("stream_memory", f"""
WITH {UG}, x AS (SELECT src AS node, t, h FROM ug JOIN (SELECT vec_id, embedding AS h FROM embeddings) ON vec_id = tgt UNION ALL SELECT tgt, t, h FROM ug JOIN (SELECT vec_id, embedding AS h FROM embeddings) ON vec_id = src),
l AS (SELECT node, max(t) AS last_t FROM x GROUP BY 1),
w AS (SELECT x.node, last_t, exp(-ln(2::DOUBLE) / {HALF}::DOUBLE * (last_t - t)) AS k, h FROM x JOIN l ON l.node = x.node)
SELECT node, last_t::DOUBLE AS last_t, count(*) AS n, round(sum(k), 5) AS weight, round(sum(k * h[1]) / sum(k), 6) AS first, round(sum(k * h[8]) / sum(k), 6) AS last FROM w GROUP BY 1, 2""")
def stream_memory(spark, sf):
    v = base.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("nbr"), F.transform("embedding", lambda x: x.cast("double")).alias("msg")
    )
    messages = op.ends_of(edge_stream(spark, ug(spark, sf)), "edge_pos", "t").join(v, "nbr")
    out, _ = rp.run_to_table(op.node_memory(messages.select("node", "edge_pos", "t", "msg"), 64, HALF), "update", "memory")
    state = op.merge_memory(rp.latest(out, ["node", "salt"]), 64, HALF)
    return state.select(
        "node", "last_t", "n", F.round("weight", 5).alias("weight"),
        F.round(F.get("state", F.lit(0)), 6).alias("first"), F.round(F.get("state", F.lit(7)), 6).alias("last"),
    )


@query("stream_neighbors", f"""
WITH {UG}, x AS (SELECT src AS node, tgt AS nbr, edge_pos FROM ug UNION ALL SELECT tgt, src, edge_pos FROM ug),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY edge_pos DESC, nbr DESC) AS rn FROM x)
SELECT node, string_agg(nbr::VARCHAR, ',' ORDER BY rn DESC) AS nbrs FROM r WHERE rn <= 5 GROUP BY 1""")
def stream_neighbors(spark, sf):
    out, _ = rp.run_to_table(op.stream_neighbors(edge_stream(spark, ug(spark, sf)), 5), "update", "neighbors")
    last = rp.latest(out, ["node"])
    return last.select("node", F.concat_ws(",", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs"))


@query("stream_reservoir")
def stream_reservoir(spark, sf):
    out, _ = rp.run_to_table(op.stream_reservoir(edge_stream(spark, ug(spark, sf)), 4, "sr"), "update", "reservoir")
    last = rp.latest(out, ["node"])
    return last.select("node", "degree", F.concat_ws(",", F.transform("slots", lambda x: x.cast("string"))).alias("slots"))


@query("stream_rolling", f"""
WITH {BIP_S} SELECT edge_pos, round(disc, 9) AS score FROM bs WHERE label <= 0 ORDER BY edge_pos DESC LIMIT 300""")
def stream_rolling(spark, sf):
    e = base.bip_split(spark, sf).select("src", "tgt", "t", "edge_pos", "label", F.col("disc").alias("score"))
    out, _ = rp.run_to_table(op.rolling_scores(edge_stream(spark, e), 300), "update", "rolling")
    return op.last_scores(rp.latest(out, ["shard"]), 300).withColumn("score", F.round("score", 9))


@query("stream_scoring", f"""
WITH {BIP_S}, k AS (SELECT src, tgt, count(*) AS k FROM bs WHERE split = 'train' GROUP BY 1, 2)
SELECT edge_pos, round(1.0::DOUBLE / (1 + coalesce(k, 0)), 9) AS score FROM bs LEFT JOIN k USING (src, tgt) WHERE split <> 'train'""")
def stream_scoring(spark, sf):
    e = base.bip_split(spark, sf)
    known = e.filter(F.col("split") == "train").groupBy("src", "tgt").agg(F.count("*").alias("k"))
    rest = e.filter(F.col("split") != "train").select("src", "tgt", "t", "edge_pos")

    def score(batch):
        novelty = F.lit(1.0) / (F.lit(1) + F.coalesce("k", F.lit(0)))
        return batch.join(known, ["src", "tgt"], "left").select("edge_pos", F.round(novelty, 9).alias("score"))

    path = rp.write_slices(rest, SLICES)
    stream = rp.read_stream(spark, path, spark.read.parquet(path).schema)
    root = f"{scratch_dir(spark)}/tgraph/scored-{uuid.uuid4().hex}"
    rp.score_batches(stream, score, f"{root}/rows", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/rows").select("edge_pos", "score")
