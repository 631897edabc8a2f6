"""Positions and running sums, with hot groups forced through range partitions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tgraph.operators import ordering as od


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = [(i, "hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.randint(0, 20)) for i in range(600)]
    return spark.createDataFrame(data, "id bigint, g string, v bigint").repartition(5)


def test_global_position(rows):
    got = od.global_position(rows, ["v", "id"], "p").toPandas().sort_values("p")
    assert list(got["p"]) == list(range(600))
    assert got[["v", "id"]].apply(tuple, axis=1).is_monotonic_increasing


@pytest.mark.parametrize("limit", [1, 10**9])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_sum(rows, limit, group):
    out = od.running(rows, group, ["v", "id"], {"s": F.col("v")}, group_rows=limit).toPandas()
    want = out.sort_values(["v", "id"])
    want = want.groupby("g")["v"].cumsum() if group else want["v"].cumsum()
    assert (out["s"] == want.reindex(out.index)).all()


@pytest.mark.parametrize("how", ["max", "min"])
def test_running_extremes(rows, how):
    out = od.running(rows, ["g"], ["id"], {"s": F.col("v")}, group_rows=1, how=how).toPandas()
    want = getattr(out.sort_values("id").groupby("g")["v"], f"cum{how}")()
    assert (out["s"] == want.reindex(out.index)).all()


@pytest.mark.parametrize("by", [1, -1])
def test_shifted_across_chunks(rows, by):
    placed = od.global_position(rows, ["g", "v", "id"], "p")
    out = od.shifted(placed, "p", {"other": F.col("id")}, by, ["g"], chunk_rows=7).toPandas().sort_values("p")
    want = out.groupby("g")["id"].shift(-by)
    assert len(out) == 600
    pd.testing.assert_series_equal(out["other"].astype(float), want.astype(float), check_names=False)


@pytest.mark.parametrize("limit", [1, 10**9])
def test_group_quantiles(rows, limit):
    got = od.group_quantiles(rows, ["g"], "v", {"a": 0.5, "b": 0.93}, limit).toPandas().set_index("g")
    frame = rows.toPandas()
    for name, p in (("a", 0.5), ("b", 0.93)):
        want = frame.groupby("g")["v"].quantile(p)
        assert got[name].sub(want).abs().max() < 1e-9
