import itertools
import random

import pytest
from pyspark.sql import functions as F

from tgraph.streaming import operators as op
from tgraph.streaming import replay as rp
from tgraph.streaming import runs as rn


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, (i * 7) % 9, 10 + (i * 5) % 8, i * 60_000_000) for i in range(120)]
    return spark.createDataFrame(rows, "edge_pos bigint, src bigint, tgt bigint, t bigint")


def stream(spark, edges):
    path = rp.write_slices(edges, 3)
    return rp.read_stream(spark, path, spark.read.parquet(path).schema)


def test_reservoir_equals_sequential(spark, edges):
    out, query = rp.run_to_table(op.stream_reservoir(stream(spark, edges), 3, "x"), "update")
    got = {r["node"]: (r["degree"], r["slots"]) for r in rp.latest(out, ["node"]).collect()}
    state = {}
    for r in edges.orderBy("edge_pos").collect():
        for node, nbr in ((r["src"], r["tgt"]), (r["tgt"], r["src"])):
            slots, degree = state.get(node, ([-1] * 3, 0))
            state[node] = op.reservoir_step(list(slots), degree, nbr, node, "x")
    assert got == {n: (d, s) for n, (s, d) in state.items()}
    log = rp.progress_log(query, "r")
    assert log.agg(F.sum("num_edges")).first()[0] == 120


def test_draw_matches_the_column(spark):
    from tgraph.functions.random import pick

    rows = spark.range(50).select("id", pick(17, "s", "id", F.lit(3)).alias("p")).collect()
    assert all(r["p"] == op.draw(17, "s", r["id"], 3) for r in rows)


def test_degrees_and_memory(spark, edges):
    out, _ = rp.run_to_table(op.stream_degrees(stream(spark, edges)), "update")
    got = {r["node"]: r["degree"] for r in rp.latest(out, ["node"]).collect()}
    ends = op.ends_of(edges).groupBy("node").count().collect()
    assert got == {r["node"]: r["count"] for r in ends}

    half = 30 * 60_000_000.0
    messages = op.ends_of(stream(spark, edges), "edge_pos", "t").withColumn("msg", F.array(F.col("nbr").cast("double")))
    out, _ = rp.run_to_table(op.node_memory(messages, 1, half, 4), "update")
    state = {r["node"]: r for r in op.merge_memory(rp.latest(out, ["node", "salt"]), 1, half).collect()}
    rows = op.ends_of(edges, "t").collect()
    for node, r in state.items():
        mine = [(x["t"], x["nbr"]) for x in rows if x["node"] == node]
        last = max(t for t, _ in mine)
        w = [0.5 ** ((last - t) / half) for t, _ in mine]
        assert r["state"][0] == pytest.approx(sum(a * n for a, (_, n) in zip(w, mine)) / sum(w))
        assert r["n"] == len(mine)


def test_memory_over_many_half_lives(spark, edges):
    """Sums in the cluster, without a Python call a key, over a time in which plain growth would overflow."""
    half = 3 * 1_000_000.0
    few = edges.withColumn("t", F.when(F.col("edge_pos") < 3, F.col("t") - 10**12).otherwise(F.col("t")))
    messages = op.ends_of(stream(spark, few), "edge_pos", "t").withColumn("msg", F.array(F.col("nbr").cast("double"), F.lit(-1.0)))
    memory = op.node_memory(messages, 2, half)
    assert "InPandas" not in memory._jdf.queryExecution().analyzed().toString()
    out, _ = rp.run_to_table(memory, "update")
    got = {r["node"]: r for r in op.merge_memory(rp.latest(out, ["node", "salt"]), 2, half).collect()}
    rows = op.ends_of(few, "t").collect()
    assert set(got) == {r["node"] for r in rows}
    for node, r in got.items():
        mine = [(x["t"], x["nbr"]) for x in rows if x["node"] == node]
        last = max(t for t, _ in mine)
        w = [0.5 ** ((last - t) / half) for t, _ in mine]
        assert (r["last_t"], r["n"]) == (last, len(mine))
        assert r["weight"] == pytest.approx(sum(w)) and r["state"][1] == pytest.approx(-1)
        assert r["state"][0] == pytest.approx(sum(a * n for a, (_, n) in zip(w, mine)) / sum(w))


def test_late_edges_are_listed(spark, edges):
    stamped = edges.withColumn("ts", F.timestamp_micros("t"))
    late = op.late_edges(stamped, "1970-01-01 01:00:00", "30 minutes")
    assert late.count() == 30


def test_event_runs_of_shuffled_and_late_input(spark, tmp_path):
    """Batches with edges out of order, too late, at one time, and without source or time."""
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), i // 3 * 10) for i in range(90)]
    order = sorted(rows, key=lambda r: r[0] + rng.choice([0, 0, 8, 40]))
    rows = [(*r, i) for i, r in enumerate(order)] + [(90, 5, None, 90)]
    e = spark.createDataFrame(rows, "edge_pos bigint, src bigint, t bigint, arrival bigint")
    path = rp.write_slices(e, 5, "arrival")
    schema = spark.read.parquet(path).schema
    root = str(tmp_path / "runs")
    query = rn.event_runs(rp.read_stream(spark, path, schema), root, 50)
    query.awaitTermination()
    assert query.exception() is None
    rn.finish(spark, root, schema)

    bound, top, used, late = None, None, [], []
    for k in range(5):
        part = rows[k * 19 : (k + 1) * 19]
        for r in part:
            (late if r[2] is None or (bound is not None and r[2] < bound) else used).append((k, r))
        top = max([r[2] for _, r in used])
        bound = top - 50
    assert {(r["batch_id"], r["edge_pos"]) for r in rn.read_late(spark, root, schema).collect()} == {(k, r[0]) for k, r in late}
    assert len(late) > 3
    key = lambda r: (r[2], r[1] is not None, r[1] or 0)
    want = []
    for src, group in itertools.groupby(sorted([r for _, r in used], key=key), lambda r: r[1]):
        t = [r[2] for r in group]
        want.append((len(want), src, len(t), t[0], t[-1]))
    got = rn.read_runs(spark, root, schema).orderBy("run").collect()
    assert [tuple(r) for r in got] == want


def test_a_repeated_batch_gives_the_same_runs(spark, tmp_path):
    root = str(tmp_path / "runs")
    part = spark.createDataFrame([(1, 10), (1, 20), (2, 30), (2, 90)], "src bigint, t bigint")
    for k in (0, 0, 1, 1):
        rn._step(root, part.withColumn("t", F.col("t") + 100 * k), k, 40)
    rn._step(root, part.limit(0), 2, None)
    got = rn.read_runs(spark, root, part.schema).orderBy("run").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 10, 20), (1, 2, 2, 30, 90), (2, 1, 2, 110, 120), (3, 2, 2, 130, 190)]


def test_a_stream_without_batches_has_no_runs(spark, tmp_path):
    schema = spark.createDataFrame([], "src bigint, t bigint").schema
    root = str(tmp_path / "runs")
    rn.finish(spark, root, schema)
    assert rn.read_runs(spark, root, schema).count() == rn.read_late(spark, root, schema).count() == 0
