import math

import pytest

from tgraph.operators import metrics as m


@pytest.fixture
def scored(spark):
    def make(pairs):
        data = [(i, float(s), int(y)) for i, (s, y) in enumerate(pairs)]
        return spark.createDataFrame(data, "id bigint, score double, label bigint")

    return make


GOOD = [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 1), (0.4, 0), (0.3, 0), (0.2, 0), (0.1, 0)]


def test_auc_extremes(scored):
    assert m.roc_auc(scored(GOOD)).first()["roc_auc"] == 1.0
    assert m.roc_auc(scored([(1 - s, y) for s, y in GOOD])).first()["roc_auc"] == 0.0
    assert m.roc_auc(scored([(0.5, y) for _, y in GOOD])).first()["roc_auc"] == 0.5


def test_ties(scored):
    pairs = [(0.5, 1), (0.5, 0), (0.5, 0), (0.9, 0), (0.1, 1), (0.7, 1)]
    auc = m.roc_auc(scored(pairs)).first()["roc_auc"]
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(want)


def test_no_positives(scored):
    df = scored([(s, 0) for s, _ in GOOD])
    assert m.average_precision(df).first()["average_precision"] == 0.0
    assert m.rank_metrics(df, ks=()).first()["mrr"] == 0.0
    row = m.best_f1_scan(df).first()
    assert row["best_f1"] == 0.0 and math.isnan(row["best_threshold"])
    assert m.group_coverage(df.withColumnRenamed("label", "group_id"), 0.5).first()["mean_group_coverage"] is None


def test_max_f1_takes_lowest_threshold(scored):
    row = m.max_f1(scored(GOOD)).first()
    assert (row["max_f1"], row["best_threshold"]) == (1.0, 0.6)


def test_runs_in_one_job_equal_single_runs(spark):
    data = [(r, i, float((i * 7 + r * 3) % 11), int((i + r) % 3 == 0)) for r in range(3) for i in range(30)]
    df = spark.createDataFrame(data, "run int, id bigint, score double, label bigint")
    both = {r["run"]: r for r in m.compute_metrics(df, ["run"]).collect()}
    legacy = {r["run"]: r for r in m.legacy_metrics(df, ["run"]).collect()}
    for run in range(3):
        one = m.compute_metrics(df.filter(f"run = {run}").drop("run")).first()
        old = m.legacy_metrics(df.filter(f"run = {run}").drop("run")).first()
        for key in one.asDict():
            assert both[run][key] == pytest.approx(one[key])
        for key in ("best_f1", "best_threshold", "average_precision", "mrr", "accuracy"):
            assert legacy[run][key] == pytest.approx(old[key])


def test_flipped_convention(scored):
    df = scored(GOOD)
    flipped = scored([(1 - s, 1 - y) for s, y in GOOD])
    assert m.legacy_metrics(flipped, anomaly_as_0=True).first()["roc_auc"] == m.legacy_metrics(df).first()["roc_auc"]
