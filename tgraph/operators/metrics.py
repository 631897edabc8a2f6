"""Detection metrics over scored edges (columns ``score``, ``label``, ``id``).

Every function takes ``by``, the columns that tell runs apart, and scores all
runs in one job.  Equal scores are counted before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.operators.ordering import group_quantiles, running
from tgraph.session import materialize


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _keyed(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-run totals; with no run columns they are one literal row."""
    if by:
        return df.join(totals, list(by))
    row = totals.first()
    return df.withColumns({k: F.lit(row[k]) for k in totals.columns})


def curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: own and cumulative positives/negatives, descending."""
    by = list(by)
    y = (F.col("label") != 0).cast("bigint")
    counted = materialize(
        scored.groupBy(*by, "score").agg(
            F.sum(y).alias("pos"), F.sum(F.lit(1).cast("bigint") - y).alias("neg")
        ),
        "curve",
    )
    summed = running(
        counted, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}
    )
    totals = counted.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    return _keyed(summed, totals, by)


def _rates(c: DataFrame) -> DataFrame:
    precision = _d("tp") / _d(F.col("tp") + F.col("fp"))
    recall = F.when(F.col("n_pos") > 0, _d("tp") / _d("n_pos")).otherwise(F.lit(0.0))
    out = c.withColumns({"precision": precision, "recall": recall})
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / total)
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def pr_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold, precision, recall and F1 per distinct score."""
    return _rates(curve(scored, by)).select(
        *by, F.col("score").alias("threshold"), "precision", "recall", "f1"
    )


def _auc_expr() -> Column:
    below = F.col("n_neg") - F.col("fp")
    wins = F.sum(_d("pos") * (_d(below) + F.lit(0.5) * _d("neg")))
    pairs = F.max(_d("n_pos") * _d("n_neg"))
    return F.when(pairs > 0, wins / pairs)


def _ap_expr() -> Column:
    gain = F.sum(_d("pos") * _d("tp") / _d(F.col("tp") + F.col("fp")))
    n = F.max(_d("n_pos"))
    return F.when(n > 0, gain / n).otherwise(F.lit(0.0))


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve(scored, by).groupBy(*by).agg(_auc_expr().alias("roc_auc"))


def average_precision(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve(scored, by).groupBy(*by).agg(_ap_expr().alias("average_precision"))


def _best(rates: DataFrame, by: Sequence[str]) -> DataFrame:
    first = F.max_by(
        F.struct("f1", "score", "precision", "recall", "tp", "fp", "n_pos", "n_neg"),
        F.struct(F.col("f1"), -F.col("score")),
    )
    return rates.groupBy(*by).agg(
        first.alias("b"), _auc_expr().alias("roc_auc"), _ap_expr().alias("average_precision")
    )


def max_f1(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best F1 on the precision-recall curve; the lowest such threshold."""
    best = _best(_rates(curve(scored, by)), by)
    return best.select(
        *by,
        F.col("b.f1").alias("max_f1"),
        F.col("b.score").alias("best_threshold"),
        F.col("b.precision").alias("max_precision"),
        F.col("b.recall").alias("max_recall"),
    )


def compute_metrics(
    scored: DataFrame, by: Sequence[str] = (), group_id: str | None = None
) -> DataFrame:
    """The full metric row of each run; group coverage if ``group_id`` is named."""
    best = _best(_rates(curve(scored, by)), by)
    tn = F.col("b.n_neg") - F.col("b.fp")
    n = F.col("b.n_pos") + F.col("b.n_neg")
    tpr = F.when(F.col("b.n_pos") > 0, _d("b.tp") / _d("b.n_pos"))
    tnr = F.when(F.col("b.n_neg") > 0, _d(tn) / _d("b.n_neg"))
    balanced = F.when(tpr.isNull(), tnr).when(tnr.isNull(), tpr).otherwise((tpr + tnr) / 2.0)
    out = best.select(
        *by,
        F.col("b.f1").alias("max_f1"),
        F.col("b.score").alias("best_threshold"),
        "roc_auc",
        "average_precision",
        (_d(F.col("b.tp") + tn) / _d(n)).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        F.col("b.precision").alias("max_precision"),
        F.col("b.recall").alias("max_recall"),
    )
    if group_id is None:
        return out
    if by:
        limit = out.select(*by, F.col("best_threshold").alias("_t"))
        covered = group_coverage(scored.join(limit, list(by)), F.col("_t"), by, group_id)
        return out.join(covered, list(by), "left")
    row = out.first()
    covered = group_coverage(scored, F.lit(row["best_threshold"]), by, group_id).first()
    return out.withColumns({k: F.lit(covered[k]) for k in covered.asDict()})


def confusion(
    scored: DataFrame, threshold: float | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Counts at a threshold with accuracy, precision, recall and F1."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, p = F.col("label") != 0, F.col("score") >= cut
    counts = scored.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"),
    )
    tp, fp, tn, fn = (_d(c) for c in ("tp", "fp", "tn", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    out = counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
        }
    )
    pr, rc = F.col("precision"), F.col("recall")
    balanced = (F.col("recall") + ratio(tn, tn + fp)) / 2.0
    return out.withColumns({"f1": ratio(2.0 * pr * rc, pr + rc), "balanced_accuracy": balanced})


def ranked(scored: DataFrame, by: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """Rank by descending score with a fixed tie-break, and hits so far."""
    y = (F.col("label") != 0).cast("bigint")
    rows = scored.select(*by, "score", F.col(tie).alias("_id"), y.alias("y"))
    out = running(
        rows,
        by,
        [F.col("score").desc(), F.col("_id")],
        {"rank": F.lit(1).cast("bigint"), "hits": F.col("y")},
    )
    return out.withColumnRenamed("_id", tie)


def rank_metrics(
    scored: DataFrame, by: Sequence[str] = (), ks: Sequence[int] = (10, 50, 100), tie: str = "id"
) -> DataFrame:
    """Row-wise average precision, reciprocal rank and precision/recall at k.

    A k beyond the number of rows yields null.
    """
    r = ranked(scored, by, tie)
    n_pos = F.sum("y")
    zero = F.lit(0.0)
    hit = F.col("y") == 1
    ap = F.sum(F.when(hit, _d("hits") / _d("rank"))) / _d(n_pos)
    mrr = F.avg(F.when(hit, F.lit(1.0) / _d("rank")))
    aggs = [
        F.when(n_pos > 0, ap).otherwise(zero).alias("average_precision"),
        F.when(n_pos > 0, mrr).otherwise(zero).alias("mrr"),
    ]
    for k in ks:
        found = F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(F.lit(0)))
        enough = F.count("*") >= k
        aggs.append(F.when(enough, _d(found) / F.lit(float(k))).alias(f"precision_at_{k}"))
        aggs.append(
            F.when(enough, F.when(n_pos > 0, _d(found) / _d(n_pos)).otherwise(zero)).alias(
                f"recall_at_{k}"
            )
        )
    return r.groupBy(*by).agg(*aggs)


def best_f1_scan(scored: DataFrame, by: Sequence[str] = (), tie: str = "id") -> DataFrame:
    """Best F1 going down the ranking; threshold midway to the next score.

    NaN threshold and F1 0 when a run has no positives.
    """
    by = list(by)
    totals = scored.groupBy(*by).agg(F.sum((F.col("label") != 0).cast("bigint")).alias("n_pos"))
    r = _keyed(ranked(scored, by, tie), totals, by)
    p, q = _d("hits") / _d("rank"), _d("hits") / _d("n_pos")
    f1 = F.when(F.col("n_pos") > 0, 2.0 * p * q / (p + q + F.lit(1e-12))).otherwise(F.lit(0.0))
    r = materialize(r.select(*by, "rank", "score", "n_pos", f1.alias("f1")), "best_f1")
    best = r.groupBy(*by).agg(
        F.max_by(F.struct("f1", "rank", "score", "n_pos"), F.struct("f1", -F.col("rank"))).alias("b")
    )
    best = best.select(*by, "b.*")
    following = r.select(*by, (F.col("rank") - 1).alias("rank"), F.col("score").alias("next_score"))
    out = best.join(following, [*by, "rank"], "left")
    middle = F.coalesce((F.col("score") + F.col("next_score")) / 2.0, F.col("score"))
    return out.select(
        *by,
        F.col("f1").alias("best_f1"),
        F.when(F.col("n_pos") > 0, middle).otherwise(F.lit(float("nan"))).alias("best_threshold"),
    )


def legacy_metrics(
    scored: DataFrame, by: Sequence[str] = (), anomaly_as_0: bool = False, tie: str = "id"
) -> DataFrame:
    """The older metric row: scan F1, AUC, row-wise AP, MRR, confusion, at-k."""
    by = list(by)
    df = scored.withColumn("label", (F.col("label") != 0).cast("bigint"))
    if anomaly_as_0:
        df = df.withColumns({"label": 1 - F.col("label"), "score": 1.0 - F.col("score")})
    f1 = best_f1_scan(df, by, tie)
    auc = roc_auc(df, by)
    ranks = rank_metrics(df, by, tie=tie)
    if by:
        cut = confusion(df.join(f1, by), F.col("best_threshold"), by)
        cut = cut.select(*by, "accuracy", "precision", "recall")
        return f1.join(auc, by).join(ranks, by).join(cut, by)
    row = f1.first()
    cut = confusion(df, row["best_threshold"]).select("accuracy", "precision", "recall")
    one = [d.first().asDict() for d in (auc, ranks, cut)]
    merged = {k: v for d in one for k, v in d.items()}
    return f1.withColumns(
        {k: F.lit(v) if v is not None else F.lit(None).cast("double") for k, v in merged.items()}
    )


def group_coverage(
    scored: DataFrame, threshold: float | Column, by: Sequence[str] = (), group_id: str = "group_id"
) -> DataFrame:
    """Share of each anomaly group at or above the threshold, summarised."""
    by = list(by)
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    per_group = (
        scored.filter(F.col(group_id) > 0)
        .groupBy(*by, group_id)
        .agg(
            F.avg((F.col("score") >= cut).cast("double")).alias("coverage"),
            F.avg("score").alias("mean_score"),
        )
    )
    stats = per_group.groupBy(*by).agg(
        F.avg("coverage").alias("mean_group_coverage"),
        F.min("coverage").alias("min_group_coverage"),
        F.max("coverage").alias("max_group_coverage"),
        F.avg("mean_score").alias("avg_score_within_groups"),
    )
    middle = group_quantiles(per_group, by, "coverage", {"median_group_coverage": 0.5})
    if by:
        return stats.join(middle, by)
    value = middle.first()["median_group_coverage"]
    return stats.withColumn("median_group_coverage", F.lit(value).cast("double"))


def best_trial(trials: DataFrame, metric: str, by: Sequence[str] = (), trial: str = "trial") -> DataFrame:
    """The trial with the best value of ``metric``; the earliest on ties."""
    row = F.max_by(F.struct(trial, metric), F.struct(F.col(metric), -F.col(trial)))
    return trials.groupBy(*by).agg(row.alias("b")).select(*by, "b.*")
