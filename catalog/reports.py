"""Report and stream-profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.detection import rounded
from tgraph.operators import profile as pf
from tgraph.operators import report as rp
from tgraph.operators.ordering import global_position
from tgraph.plans import base

QUERIES, ORACLE, query = register()


def cube(spark, sf):
    """Orders as a result table: priority, status and year as dimensions."""
    return base.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("method"),
        F.col("o_orderstatus").alias("dataset"),
        F.year("o_orderdate").cast("bigint").alias("anom_ratio"),
        F.col("o_totalprice").alias("rocauc"),
        F.col("o_orderkey").alias("id"),
    )


CUBE = """
cube AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, year(o_orderdate) AS anom_ratio,
                o_totalprice AS rocauc, o_orderkey AS id FROM orders)
"""


def log(spark, sf):
    """Events per hour as a log of scored snapshots; one run per event type."""
    return (
        base.table(spark, sf, "events")
        .select("event_type", "value", base.micros("ts").alias("t"))
        .groupBy(
            F.col("event_type").alias("run"),
            F.floor(F.col("t") / F.lit(3_600_000_000)).cast("bigint").alias("seq"),
        )
        .agg(
            F.count("*").alias("num_edges"),
            (F.max("value") / F.lit(1000.0)).alias("elapsed"),
            F.when(F.count("*") > 1, (F.max("t") - F.min("t")) / F.lit(1_000_000.0)).alias("span"),
        )
    )


LOG = """
log AS (SELECT event_type AS run, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS seq, count(*) AS num_edges,
               max(value) / 1000.0::DOUBLE AS elapsed,
               CASE WHEN count(*) > 1 THEN (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE END AS span
        FROM events GROUP BY 1, 2),
nm AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS rn, count(*) OVER (PARTITION BY run) AS n FROM log),
wm AS (SELECT *, least(n, greatest(5, CAST(ceil(n * 0.1::DOUBLE) AS BIGINT))) AS warmup FROM nm),
ms AS (SELECT * FROM wm WHERE rn > warmup)
"""


@query("latency_profile", f"""
WITH {LOG}, x AS (
  SELECT run, max(warmup) AS warmup_snapshots, count(*) FILTER (rn > warmup) AS snapshots_after_warmup FROM wm GROUP BY 1)
SELECT run, warmup_snapshots, snapshots_after_warmup, CAST(sum(num_edges) AS BIGINT) AS edges_after_warmup,
       round(sum(elapsed), 6) AS elapsed_after_warmup_sec, round(sum(num_edges) / sum(elapsed), 6) AS throughput_warmup_excluded,
       round(avg(elapsed * 1000), 6) AS latency_mean_ms, snapshots_after_warmup < 20 AS insufficient_batches,
       round(quantile_cont(elapsed * 1000, 0.5), 6) AS latency_p50_ms, round(quantile_cont(elapsed * 1000, 0.95), 6) AS latency_p95_ms,
       round(quantile_cont(elapsed * 1000, 0.99), 6) AS latency_p99_ms,
       round(quantile_cont(elapsed * 1000, 0.99) / quantile_cont(elapsed * 1000, 0.5), 6) AS latency_p99_over_p50
FROM ms JOIN x USING (run) GROUP BY run, warmup_snapshots, snapshots_after_warmup""")
def latency_profile(spark, sf):
    return rounded(pf.latency_profile(log(spark, sf)), 6)


@query("detection_delay", f"""
WITH {LOG}
SELECT run, count(*) AS snapshots_with_span, round(avg(span / 2 + elapsed), 6) AS detection_delay_mean_sec,
       round(max(span + elapsed), 6) AS detection_delay_max_sec, round(avg(span), 6) AS snapshot_span_mean_sec,
       round(max(span), 6) AS snapshot_span_max_sec, round(quantile_cont(span + elapsed, 0.95), 6) AS detection_delay_p95_sec,
       round(quantile_cont(span + elapsed, 0.99), 6) AS detection_delay_p99_sec
FROM ms WHERE span IS NOT NULL GROUP BY 1""")
def detection_delay(spark, sf):
    return rounded(pf.detection_delay(log(spark, sf)), 6)


@query("windowed_throughput", f"""
WITH {LOG}, c AS (SELECT *, sum(CAST(floor(elapsed * 1000) AS BIGINT) + 1) OVER (PARTITION BY run ORDER BY seq) AS clock FROM log),
f AS (SELECT run, greatest(0, CAST(ceil(clock / 250.0::DOUBLE) AS BIGINT) - 1) AS window_id, sum(num_edges) AS e FROM c GROUP BY 1, 2),
l AS (SELECT run, max(window_id) AS m FROM f GROUP BY 1),
w AS (SELECT run, unnest(range(0, m + 1)) AS window_id FROM l)
SELECT run, window_id, coalesce(e, 0) / 250.0::DOUBLE AS edges_per_sec FROM w LEFT JOIN f USING (run, window_id)""")
def windowed_throughput(spark, sf):
    # the clock counts whole milliseconds, so window borders are exact
    ticks = log(spark, sf).withColumn("elapsed", F.floor(F.col("elapsed") * 1000).cast("bigint") + 1)
    return pf.windowed_throughput(ticks, window_sec=250.0)


@query("latency_cdf", f"""
WITH {LOG}
SELECT run, seq, round(elapsed * 1000, 6) AS latency_ms,
       round(row_number() OVER (PARTITION BY run ORDER BY elapsed, seq) / n::DOUBLE, 9) AS fraction FROM nm""")
def latency_cdf(spark, sf):
    df = pf.latency_cdf(log(spark, sf))
    return df.withColumns({"latency_ms": F.round("latency_ms", 6), "fraction": F.round("fraction", 9)})


@query("latency_vs_degree", f"""
WITH {LOG}, d AS (
  SELECT event_type AS run, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS seq, 2.0::DOUBLE * count(*) / count(DISTINCT user_id) AS deg FROM events GROUP BY 1, 2)
SELECT run, seq, round(deg, 9) AS mean_degree, round(elapsed * 1000, 6) AS latency_ms FROM log JOIN d USING (run, seq)""")
def latency_vs_degree(spark, sf):
    e = base.table(spark, sf, "events").select(
        F.col("event_type").alias("run"), "user_id", "value",
        F.floor(base.micros("ts") / F.lit(3_600_000_000)).cast("bigint").alias("seq"),
    )
    return e.groupBy("run", "seq").agg(
        F.round(F.lit(2.0) * F.count("*") / F.countDistinct("user_id"), 9).alias("mean_degree"),
        F.round(F.max("value") / F.lit(1000.0) * 1000, 6).alias("latency_ms"),
    )


@query("run_log", """
WITH e AS (SELECT event_id, epoch_us(ts) AS stamp, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events)
SELECT event_id, stamp - first_value(stamp) OVER (ORDER BY p) AS elapsed, stamp - coalesce(lag(stamp) OVER (ORDER BY p), stamp) AS step FROM e""")
def run_log(spark, sf):
    e = base.table(spark, sf, "events").select("event_id", base.micros("ts").alias("at"))
    return pf.run_log(global_position(e, ["at", "event_id"], "p"), "p", "at").select(
        "event_id", "elapsed", "step"
    )


@query("convergence", """
WITH e AS (SELECT event_type, event_id, value, epoch_us(ts) AS stamp FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS steps FROM e)
SELECT event_type, steps, value AS best_value, event_id AS best_step, stamp AS time_to_best FROM b WHERE rn = 1""")
def convergence(spark, sf):
    e = base.table(spark, sf, "events").select("event_type", "event_id", "value", base.micros("ts").alias("at"))
    return pf.convergence(e, "value", ["event_type"], "event_id", "at")


@query("run_summary", """
WITH l AS (SELECT 'l_quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem
           UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM l GROUP BY 1""")
def run_summary(spark, sf):
    return rp.run_summary(base.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 6)


@query("result_summary", f"""
WITH {CUBE}, l AS (
  SELECT 'method' AS dimension, method AS value, rocauc FROM cube UNION ALL SELECT 'dataset', dataset, rocauc FROM cube
  UNION ALL SELECT 'anom_ratio', CAST(anom_ratio AS VARCHAR), rocauc FROM cube)
SELECT dimension, value, round(avg(rocauc), 4) AS mean, max(rocauc) AS max, min(rocauc) AS min, round(stddev_samp(rocauc), 4) AS std,
       count(rocauc) AS n, round(quantile_cont(rocauc, 0.5), 4) AS median FROM l GROUP BY 1, 2""")
def result_summary(spark, sf):
    df = rp.summarize(cube(spark, sf), "rocauc", ["method", "dataset", "anom_ratio"])
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@query("result_filter", f"""
WITH {CUBE} SELECT id, method, dataset, rocauc FROM cube
WHERE method IN ('1-URGENT', '2-HIGH') AND dataset IN ('O') AND anom_ratio IN (1994, 1995)""")
def result_filter(spark, sf):
    return rp.result_filter(
        cube(spark, sf), method=["1-URGENT", "2-HIGH"], dataset=["O"], anom_ratio=[1994, 1995]
    ).select("id", "method", "dataset", "rocauc")


@query("leaderboard", f"""
WITH {CUBE}, m AS (SELECT method, dataset, anom_ratio, round(avg(rocauc), 4) AS rocauc FROM cube GROUP BY 1, 2, 3)
SELECT method, rocauc FROM m WHERE dataset = 'F' AND anom_ratio = 1995""")
def leaderboard(spark, sf):
    m = cube(spark, sf).groupBy("method", "dataset", "anom_ratio").agg(F.round(F.avg("rocauc"), 4).alias("rocauc"))
    return rp.leaderboard(m, {"dataset": "F", "anom_ratio": 1995}, "rocauc", ["method"])


@query("pivot_heatmap", f"""
WITH {CUBE}, m AS (SELECT dataset, anom_ratio, method, round(avg(rocauc), 4) AS v FROM cube WHERE method LIKE '1%' OR method LIKE '2%' GROUP BY 1, 2, 3)
SELECT dataset, max(v) FILTER (anom_ratio = 1994 AND method LIKE '1%') AS "1994_1-URGENT", max(v) FILTER (anom_ratio = 1994 AND method LIKE '2%') AS "1994_2-HIGH",
       max(v) FILTER (anom_ratio = 1995 AND method LIKE '1%') AS "1995_1-URGENT", max(v) FILTER (anom_ratio = 1995 AND method LIKE '2%') AS "1995_2-HIGH"
FROM m GROUP BY 1""")
def pivot_heatmap(spark, sf):
    c = rp.result_filter(cube(spark, sf), method=["1-URGENT", "2-HIGH"])
    m = c.groupBy("dataset", "anom_ratio", "method").agg(F.round(F.avg("rocauc"), 4).alias("v"))
    cells = [(y, p) for y in (1994, 1995) for p in ("1-URGENT", "2-HIGH")]
    return rp.heat_map(m, "dataset", ["anom_ratio", "method"], cells, "v")


@query("median_pivot", f"""
WITH {CUBE}
SELECT method, round(quantile_cont(rocauc, 0.5) FILTER (dataset = 'F'), 4) AS "F", round(quantile_cont(rocauc, 0.5) FILTER (dataset = 'O'), 4) AS "O",
       round(quantile_cont(rocauc, 0.5) FILTER (dataset = 'P'), 4) AS "P" FROM cube GROUP BY 1""")
def median_pivot(spark, sf):
    return rounded(rp.median_pivot(cube(spark, sf), "method", "dataset", ["F", "O", "P"], "rocauc"), 4)


@query("throughput_table", f"""
WITH {CUBE}, m AS (SELECT method, dataset, format('{{:,}}', CAST(round_even(quantile_cont(rocauc, 0.5), 0) AS BIGINT)) AS v FROM cube GROUP BY 1, 2)
SELECT method, CASE WHEN method = '5-LOW' THEN 'OOM (memory-bound)' ELSE coalesce(max(v) FILTER (dataset = 'F'), '--') END AS "F",
       coalesce(max(v) FILTER (dataset = 'O'), '--') AS "O", coalesce(max(v) FILTER (dataset = 'X'), '--') AS "X" FROM m GROUP BY 1""")
def throughput_table(spark, sf):
    return rp.throughput_table(
        cube(spark, sf), ["F", "O", "X"], {("5-LOW", "F"): "memory-bound"}, "rocauc"
    )


@query("outcome_table", f"""
WITH {CUBE} SELECT method, dataset, count(*) AS runs, count(*) FILTER (rocauc <= 100000) AS succeeded,
  min(CASE WHEN rocauc > 300000 THEN 'memory' WHEN rocauc > 100000 THEN 'time' END) AS error FROM cube GROUP BY 1, 2""")
def outcome_table(spark, sf):
    c = cube(spark, sf).withColumn(
        "error", F.when(F.col("rocauc") > 300000, "memory").when(F.col("rocauc") > 100000, "time")
    )
    return rp.outcome_table(c)
