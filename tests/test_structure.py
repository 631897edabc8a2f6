import pytest
from pyspark.sql import functions as F

from tgraph.operators import structure as st
from tgraph.operators import timeline as tl
from tgraph.plans.graph import TemporalGraph
from tgraph.plans.steps import Chain, CleanStructure, SplitByTime
from tgraph.sources.writers import StepCache

MULTI = [(2, 1, 5), (1, 2, 5), (1, 2, 9), (3, 3, 1), (1, 2, 5), (4, 3, 2)]


def tuples(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_dedup_modes(graph):
    e = graph(MULTI)
    clean = st.dedup(st.canonical(st.drop_self_loops(e)), order=("edge_pos",))
    assert tuples(clean, "src", "tgt", "t", "edge_pos") == [(1, 2, 5, 0), (1, 2, 9, 2), (3, 4, 2, 5)]
    directed = st.dedup(e, order=("edge_pos",))
    assert directed.count() == 5
    assert tuples(st.undirected(e, ("edge_pos",)), "src", "tgt", "t") == [(1, 2, 5), (1, 2, 9), (3, 3, 1), (3, 4, 2)]


def test_reindex_strings(spark):
    e = spark.createDataFrame([("b", "x"), ("a", "b")], "src string, tgt string")
    coded, _, mapping = st.reindex_nodes(e)
    assert tuples(mapping, "new_id", "original_id") == [(0, "a"), (1, "b"), (2, "x")]
    assert tuples(coded, "src", "tgt") == [(0, 1), (1, 2)]


def test_event_runs(graph):
    e = graph([(s, 9, i) for i, s in enumerate([1, 1, 2, 2, 2, 1])]).withColumn("split", F.lit("train"))
    got = tl.event_snapshots(e).orderBy("edge_pos")
    assert [r["snapshot_id"] for r in got.collect()] == [0, 0, 1, 1, 1, 2]


def test_split_ties_go_early(graph):
    e = graph([(i, i + 1, 5 if i < 6 else 7) for i in range(8)])
    got = tl.split_by_quantile(e, "t", 0.5, 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 6, "test": 2}


def test_time_units(spark):
    df = spark.createDataFrame([(1.5, "2020-01-02"), (2.25, "2020-01-03")], "t double, d string")
    df = df.withColumn("d", F.to_date("d"))
    out = tl.normalize_time(tl.normalize_time(df, "t"), "d").orderBy("t").collect()
    assert [r["t"] for r in out] == [150, 225]
    assert [r["d"] for r in out] == [18263, 18264]


def test_sentinel_times(graph):
    e = graph([(1, 2, -(2**31)), (1, 2, 4)])
    assert [r["t"] for r in tl.sentinel_to_null(e, "t").orderBy("edge_pos").collect()] == [None, 4]


def test_input_checks(graph):
    e = graph([(1, 2, 3)])
    with pytest.raises(ValueError):
        tl.split_by_quantile(e, "t", 1.2)
    with pytest.raises(ValueError):
        tl.split_by_quantile(e.withColumn("split", F.lit("x")), "t", 0.5)
    with pytest.raises(ValueError):
        tl.check_time_column(e.withColumn("t", F.lit("x")), "t")
    with pytest.raises(ValueError):
        tl.whole_table_snapshots(e, 0)
    with pytest.raises(ValueError):
        CleanStructure("sideways")(TemporalGraph(e))
    with pytest.raises(ValueError):
        CleanStructure()(None)


def test_chain_cache(graph, tmp_path):
    e = graph([(i % 5, i % 3 + 5, i) for i in range(40)])
    g = TemporalGraph(e, edge_id="edge_pos")
    chain = Chain.from_config(
        [{"name": "CleanStructure"}, {"name": "SplitByTime", "params": {"train": 0.5, "val": 0.25}}],
        StepCache(str(tmp_path)),
    )
    first = chain.run(g).edges.toPandas()
    again = chain.run(g).edges.toPandas()
    assert len(list(tmp_path.iterdir())) == 2
    assert first.sort_values("edge_pos").reset_index(drop=True).equals(
        again.sort_values("edge_pos").reset_index(drop=True)
    )
    chain.add_step(SplitByTime(0.7, 0.1))
    assert len(chain.steps) == 2 and chain.steps[1].train == 0.7
