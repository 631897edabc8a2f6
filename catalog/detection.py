"""Metric queries on the scored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.sql import SCORED
from tgraph.operators import metrics as m
from tgraph.plans import base

QUERIES, ORACLE, query = register()


def rounded(df, digits=9):
    """Round all doubles; adding zero turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


CURVE = SCORED + """,
g AS (SELECT score AS s, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1),
w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS nb, sum(p) OVER (ORDER BY s DESC) AS tp,
             sum(n) OVER (ORDER BY s DESC) AS fp,
             sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g),
f AS (SELECT s, p, n, nb, tp, fp, np, nn, tp / (tp + fp)::DOUBLE AS pr, tp / np::DOUBLE AS rc,
             CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (tp / (tp + fp)::DOUBLE) * (tp / np::DOUBLE) / ((tp / (tp + fp)::DOUBLE) + (tp / np::DOUBLE)) END AS f1 FROM w),
best AS (SELECT * FROM f ORDER BY f1 DESC, s LIMIT 1)
"""

GCURVE = SCORED + """,
g AS (SELECT grp, score AS s, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY s) - n AS nb, sum(p) OVER (PARTITION BY grp ORDER BY s DESC) AS tp,
             sum(p + n) OVER (PARTITION BY grp ORDER BY s DESC) AS pp,
             sum(p) OVER (PARTITION BY grp) AS np, sum(n) OVER (PARTITION BY grp) AS nn FROM g)
"""

RANKED = SCORED + """,
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk,
             sum(label) OVER (ORDER BY score DESC, id) AS hits, sum(label) OVER () AS np, count(*) OVER () AS cnt FROM scored)
"""

AUC = "sum(p * (nb + 0.5::DOUBLE * n)) / max(np * nn)"
AP = "sum(p * tp::DOUBLE / (tp + fp)) / max(np)"


@query("roc_auc", f"WITH {CURVE} SELECT round({AUC}, 9) AS roc_auc FROM w")
def roc_auc(spark, sf):
    return rounded(m.roc_auc(base.scored_documents(spark, sf)))


@query("avg_precision", f"WITH {CURVE} SELECT round({AP}, 9) AS average_precision FROM w")
def avg_precision(spark, sf):
    return rounded(m.average_precision(base.scored_documents(spark, sf)))


@query("metrics_per_run", f"""
WITH {GCURVE}
SELECT grp, round(CASE WHEN max(np * nn) > 0 THEN {AUC} END, 9) AS roc_auc,
       round(CASE WHEN max(np) > 0 THEN sum(p * tp::DOUBLE / pp) / max(np) ELSE 0 END, 9) AS average_precision
FROM w GROUP BY 1""")
def metrics_per_run(spark, sf):
    s = base.scored_documents(spark, sf)
    both = m.compute_metrics(s, ["grp"])
    return rounded(both.select("grp", "roc_auc", "average_precision"))


@query("pr_curve", f"""
WITH {CURVE}
SELECT s AS threshold, round(pr, 9) AS precision, round(rc, 9) AS recall, round(f1, 9) AS f1 FROM f""")
def pr_curve(spark, sf):
    return rounded(m.pr_curve(base.scored_documents(spark, sf)))


@query("max_f1", f"""
WITH {CURVE}
SELECT round(f1, 9) AS max_f1, s AS best_threshold, round(pr, 9) AS max_precision, round(rc, 9) AS max_recall FROM best""")
def max_f1(spark, sf):
    return rounded(m.max_f1(base.scored_documents(spark, sf)))


@query("compute_metrics", f"""
WITH {CURVE}, a AS (SELECT {AUC} AS auc, {AP} AS ap FROM w),
gid AS (SELECT *, CASE WHEN label = 1 THEN id % 7 + 1 ELSE 0 END AS group_id FROM scored),
c AS (SELECT group_id, avg(CASE WHEN score >= (SELECT s FROM best) THEN 1.0 ELSE 0.0 END) AS cov, avg(score) AS ms FROM gid WHERE group_id > 0 GROUP BY 1)
SELECT round(f1, 9) AS max_f1, s AS best_threshold, round(auc, 9) AS roc_auc, round(ap, 9) AS average_precision,
       round((tp + nn - fp) / (np + nn)::DOUBLE, 9) AS accuracy,
       round((tp / np::DOUBLE + (nn - fp) / nn::DOUBLE) / 2, 9) AS balanced_accuracy,
       round(pr, 9) AS max_precision, round(rc, 9) AS max_recall,
       round((SELECT avg(cov) FROM c), 9) AS mean_group_coverage, round((SELECT min(cov) FROM c), 9) AS min_group_coverage,
       round((SELECT max(cov) FROM c), 9) AS max_group_coverage, round((SELECT avg(ms) FROM c), 9) AS avg_score_within_groups,
       round((SELECT quantile_cont(cov, 0.5) FROM c), 9) AS median_group_coverage
FROM best, a""")
def compute_metrics(spark, sf):
    s = base.scored_documents(spark, sf).withColumn(
        "group_id", F.when(F.col("label") == 1, F.col("id") % 7 + 1).otherwise(0)
    )
    return rounded(m.compute_metrics(s, group_id="group_id"))


@query("confusion", f"""
WITH {SCORED}, c AS (
  SELECT count(*) FILTER (label = 1 AND score >= 800) AS tp, count(*) FILTER (label = 0 AND score >= 800) AS fp,
         count(*) FILTER (label = 0 AND score < 800) AS tn, count(*) FILTER (label = 1 AND score < 800) AS fn FROM scored)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy,
       round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / (tp + fn)::DOUBLE, 9) AS recall,
       round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1,
       round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 9) AS balanced_accuracy FROM c""")
def confusion(spark, sf):
    return rounded(m.confusion(base.scored_documents(spark, sf), 800.0))


@query("rank_metrics", f"""
WITH {RANKED}
SELECT round(sum(CASE WHEN label = 1 THEN hits::DOUBLE / rk END) / max(np), 9) AS average_precision,
       round(avg(CASE WHEN label = 1 THEN 1.0::DOUBLE / rk END), 9) AS mrr,
       round(sum(CASE WHEN rk <= 10 THEN label ELSE 0 END) / 10.0::DOUBLE, 9) AS precision_at_10,
       round(sum(CASE WHEN rk <= 10 THEN label ELSE 0 END)::DOUBLE / max(np), 9) AS recall_at_10,
       round(sum(CASE WHEN rk <= 50 THEN label ELSE 0 END) / 50.0::DOUBLE, 9) AS precision_at_50,
       round(sum(CASE WHEN rk <= 50 THEN label ELSE 0 END)::DOUBLE / max(np), 9) AS recall_at_50,
       round(sum(CASE WHEN rk <= 100 THEN label ELSE 0 END) / 100.0::DOUBLE, 9) AS precision_at_100,
       round(sum(CASE WHEN rk <= 100 THEN label ELSE 0 END)::DOUBLE / max(np), 9) AS recall_at_100
FROM r""")
def rank_metrics(spark, sf):
    return rounded(m.rank_metrics(base.scored_documents(spark, sf)))


@query("best_f1_scan", f"""
WITH {RANKED}, f AS (
  SELECT *, 2 * (hits / rk::DOUBLE) * (hits / np::DOUBLE) / (hits / rk::DOUBLE + hits / np::DOUBLE + 1e-12) AS f1,
         lead(score) OVER (ORDER BY rk) AS nxt FROM r)
SELECT round(f1, 9) AS best_f1, round(coalesce((score + nxt) / 2, score), 9) AS best_threshold FROM f ORDER BY f.f1 DESC, rk LIMIT 1""")
def best_f1_scan(spark, sf):
    return rounded(m.best_f1_scan(base.scored_documents(spark, sf)))


@query("legacy_metrics", f"""
WITH {RANKED}, f AS (
  SELECT *, 2 * (hits / rk::DOUBLE) * (hits / np::DOUBLE) / (hits / rk::DOUBLE + hits / np::DOUBLE + 1e-12) AS f1,
         lead(score) OVER (ORDER BY rk) AS nxt FROM r),
b AS (SELECT f1, coalesce((score + nxt) / 2, score) AS thr FROM f ORDER BY f1 DESC, rk LIMIT 1),
k AS (SELECT count(*) FILTER (label = 1 AND score >= thr) AS tp, count(*) FILTER (label = 0 AND score >= thr) AS fp,
             count(*) FILTER (label = 0 AND score < thr) AS tn, count(*) FILTER (label = 1 AND score < thr) AS fn FROM scored, b),
g AS (SELECT score AS s, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1),
w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS nb, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g)
SELECT round(b.f1, 9) AS best_f1, round(thr, 9) AS best_threshold, (SELECT round({AUC}, 9) FROM w) AS roc_auc,
       (SELECT round(sum(CASE WHEN label = 1 THEN hits::DOUBLE / rk END) / max(np), 9) FROM r) AS average_precision,
       (SELECT round(avg(CASE WHEN label = 1 THEN 1.0::DOUBLE / rk END), 9) FROM r) AS mrr,
       round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy, round(tp / (tp + fp)::DOUBLE, 9) AS precision,
       round(tp / (tp + fn)::DOUBLE, 9) AS recall
FROM b, k""")
def legacy_metrics(spark, sf):
    df = rounded(m.legacy_metrics(base.scored_documents(spark, sf)))
    return df.select("best_f1", "best_threshold", "roc_auc", "average_precision", "mrr", "accuracy", "precision", "recall")


@query("group_coverage", f"""
WITH {SCORED}, c AS (
  SELECT lang, grp, avg(CASE WHEN score >= 800 THEN 1.0 ELSE 0.0 END) AS cov, avg(score) AS ms FROM scored WHERE label > 0 GROUP BY 1, 2)
SELECT lang, round(avg(cov), 9) AS mean_group_coverage, round(min(cov), 9) AS min_group_coverage, round(max(cov), 9) AS max_group_coverage,
       round(avg(ms), 9) AS avg_score_within_groups, round(quantile_cont(cov, 0.5), 9) AS median_group_coverage
FROM c GROUP BY 1""")
def group_coverage(spark, sf):
    s = base.scored_documents(spark, sf).filter(F.col("label") > 0).withColumn("group_id", F.length("grp"))
    s = s.withColumn("group_id", F.xxhash64("grp").bitwiseAND(F.lit(2**62 - 1)) + 1)
    return rounded(m.group_coverage(s, 800.0, ["lang"]))


@query("best_trial", f"""
WITH {SCORED}, t AS (SELECT lang, id % 11 AS trial, avg(label) AS val_auc FROM scored GROUP BY 1, 2)
SELECT lang, trial, round(val_auc, 9) AS val_auc FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY val_auc DESC, trial) AS rn FROM t) WHERE rn = 1""")
def best_trial(spark, sf):
    t = base.scored_documents(spark, sf).groupBy("lang", (F.col("id") % 11).alias("trial")).agg(
        F.avg("label").alias("val_auc")
    )
    return rounded(m.best_trial(t, "val_auc", ["lang"]))
