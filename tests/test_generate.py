"""Properties of generated edges."""

import pytest
from pyspark.sql import functions as F

from catalog import injection
from tgraph.operators import inject as ij
from tgraph.operators import negatives as ng
from tgraph.operators import sampling
from tgraph.operators.sampling import non_edges, observed_pairs, pair_product, weighted_pick
from tgraph.functions.random import u01


@pytest.fixture(scope="module")
def edges(spark):
    rows = spark.range(900).select(
        F.col("id").alias("edge_pos"),
        F.floor(u01("a", "id") * 60).cast("bigint").alias("src"),
        (F.floor(u01("b", "id") * 60) + 60).cast("bigint").alias("tgt"),
        (F.col("id") * 10).alias("t"),
        F.when(F.col("id") < 450, "train").when(F.col("id") < 675, "val").otherwise("test").alias("split"),
        F.array(u01("m", "id"), u01("n", "id")).alias("msg"),
    )
    return rows.cache()


STATS = {"mean_degree": 6.0, "std_degree": 2.0, "avg_cluster_size": 20.0, "est_diameter": 4.0}


@pytest.mark.parametrize("kind", ij.GROUP_TYPES)
def test_groups(edges, kind):
    comm = edges.select(F.explode(F.array("src", "tgt")).alias("node_id")).distinct()
    comm = comm.withColumn("cluster", F.col("node_id") % 4)
    new, report = ij.inject(edges, kind, {"val": 0.1, "test": 0.2}, 120, STATS, "small", comm, 3, 2)
    rows = new.collect()
    seen = {frozenset((r["src"], r["tgt"])) for r in edges.select("src", "tgt").collect()}
    pairs = [frozenset((r["src"], r["tgt"])) for r in rows]
    assert all(len(p) == 2 for p in pairs) and len(set(pairs)) == len(pairs)
    assert not set(pairs) & seen
    size = {"random": 10, "burst": 12, "clique": 28, "path": 5, "bridge": 1}[kind]
    for split, target in (("val", 22), ("test", 45)):
        made = [r for r in rows if r["split"] == split]
        assert report["splits"][split] == {
            "ratio": {"val": 0.1, "test": 0.2}[split], "requested": target, "generated": len(made),
        }
        assert target <= len(made) < target + size
        span = {"val": (4500, 6740), "test": (6750, 8990)}[split]
        assert all(span[0] <= r["t"] <= span[1] + 1e-6 for r in made)
        by_group = {}
        for r in made:
            by_group.setdefault(r["group_id"], []).append(r["t"])
        assert all(max(v) - min(v) <= 0.1 * (span[1] - span[0]) + 1e-6 for v in by_group.values())
    merged = ij.merge_injected(edges, new)
    assert merged.count() == 900 + len(rows)
    summary = {r["split"]: r for r in ij.injection_summary(merged).collect()}
    assert summary["train"]["generated"] == 0 and summary["val"]["generated"] == report["splits"]["val"]["generated"]


def test_injection_goes_on_until_no_pair_is_left(spark):
    # 80 of 100,128 pairs are unseen, of which five rounds found 32
    e = spark.range(448).withColumnRenamed("id", "a").crossJoin(spark.range(448).withColumnRenamed("id", "b")).filter("a < b and not (a < 80 and b = a + 1)")
    e = e.select(F.monotonically_increasing_id().alias("edge_pos"), F.col("a").alias("src"), F.col("b").alias("tgt"), (F.col("a") * 448 + F.col("b")).alias("t"))
    e = e.withColumn("split", F.when(F.pmod("t", F.lit(2)) == 0, "train").otherwise("test"))
    target = int(e.filter("split = 'test'").count() * 0.0014)
    new, report = ij.inject(e, "random", {"test": 0.0014}, 448, STATS, "small", None, 3)
    assert target <= report["splits"]["test"]["generated"] == new.count() <= 80
    assert all(r["src"] < 81 and abs(r["src"] - r["tgt"]) == 1 for r in new.collect())


def test_row_types(edges):
    rows = ij.generate(edges, "combination", 0.2, "test", 5, window=50).collect()
    assert len(rows) == 45 and {r["kind"] for r in rows} == set(ij.ROW_TYPES)
    test = edges.filter("split = 'test'").collect()
    all_pairs = {(r["src"], r["tgt"]) for r in edges.collect()}
    with_t = {(r["src"], r["tgt"], r["t"]) for r in test}
    messages = {tuple(r["msg"]) for r in test}
    for r in rows:
        known = (r["src"], r["tgt"]) in all_pairs
        assert known != ("structural" in r["kind"])
        if r["kind"].startswith("temporal"):
            assert 6750 <= r["t"] <= 8990
            assert (r["src"], r["tgt"], r["t"]) not in with_t
        assert tuple(r["msg"]) in messages
    with pytest.raises(ValueError):
        ij.generate(edges, "sideways", 0.1, "test")


def test_granularity_and_aliases(edges):
    d = ij.time_deltas(edges.filter("split = 'train'")).first()
    assert (d["delta"], d["granularity"]) == (10, 10)
    assert ij.TYPE_ALIASES["tsc"] == "temporal-structural-contextual"
    assert ij.duration_rate("large") == 1.0 and ij.duration_rate("odd") == 0.01


def test_weighted_pick_follows_weights(spark):
    items = spark.createDataFrame([(0, 1.0), (1, 6.0), (2, 3.0)], "k int, w double")
    draws = spark.range(4000).select("id", u01("wp", "id").alias("u"))
    got = {r["k"]: r["count"] for r in weighted_pick(draws, "u", items, "w", ["k"]).groupBy("k").count().collect()}
    assert sum(got.values()) == 4000
    assert abs(got[1] - 2400) < 150 and abs(got[0] - 400) < 90


def test_every_draw_hits_one_item(spark):
    tiny = F.when(F.col("id") % 3 == 0, F.lit(0.0)).when(F.col("id") % 1000 == 1, F.lit(1e6)).otherwise(u01("w", "id") * 1e-9)
    items = spark.range(60_000).select(F.col("id").alias("k"), tiny.alias("w"))
    draws = spark.range(60_000).select("id", u01("d", "id").alias("u"))
    got = weighted_pick(draws, "u", items, "w", ["k"])
    row = got.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("w").alias("least")).first()
    assert row["n"] == row["ids"] == 60_000 and row["least"] > 0


def test_negatives_are_new(edges):
    e = edges.withColumn("snapshot_id", F.floor(F.col("edge_pos") / 100).cast("bigint"))
    pairs = {}
    for r in e.collect():
        pairs.setdefault(r["snapshot_id"], set()).add(frozenset((r["src"], r["tgt"])))
    for r in ng.per_snapshot(e, 120, 1).collect():
        assert r["u"] != r["v"] and frozenset((r["u"], r["v"])) not in pairs[r["snapshot_id"]]
    history, so_far = {}, set()
    for s in sorted(pairs):
        so_far = so_far | pairs[s]
        history[s] = so_far
    for r in ng.against_history(e, 120, 2).collect():
        assert frozenset((r["u"], r["v"])) not in history[r["snapshot_id"]]
    rows = ng.degree_weighted(e, 120, 3).collect()
    assert len(rows) == 900
    assert all(r["kept"] != r["v"] and frozenset((r["kept"], r["v"])) not in history[r["snapshot_id"]] for r in rows)


def test_full_graph_has_no_negatives(spark):
    e = spark.createDataFrame([(i, a, b, 0, 0) for i, (a, b) in enumerate([(0, 1), (0, 2), (1, 2)])],
                              "edge_pos bigint, src bigint, tgt bigint, t bigint, snapshot_id bigint")
    rows = ng.per_snapshot(e, 3, 1).collect()
    assert len(rows) == 3 and all(r["u"] is None for r in rows)


def test_the_last_non_edges_are_found(spark):
    # snapshot 0 lacks one pair of 100 nodes, snapshot 1 none; node 0 has met all but 7, then all
    pairs = [(a, b) for b in range(100) for a in range(b)]
    rows = [(a, b, 0) for a, b in pairs if (a, b) != (41, 77)] + [(41, 77, 1)]
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_pos bigint, src bigint, tgt bigint, snapshot_id bigint")
    for upper in (False, True):
        got = ng.per_snapshot(e.filter("snapshot_id = 0"), 100, 1, upper=upper)
        ends = {(r["u"], r["v"]) for r in got.collect()}
        assert ends == ({(41, 77)} if upper else {(41, 77), (77, 41)})
    assert all((r["u"] is None) == (r["snapshot_id"] == 1) for r in ng.against_history(e, 100, 2).collect())
    star = [(0, b, 0) for b in range(1, 4000) if b != 7] * 2 + [(0, 7, 1)]
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(star)], "edge_pos bigint, src bigint, tgt bigint, snapshot_id bigint")
    slots = e.select(F.col("edge_pos").alias("slot"), "snapshot_id", F.lit(0).cast("bigint").alias("kept"), F.lit(4000).cast("bigint").alias("bound"))
    got = non_edges(slots, 4000, ng.first_seen(e), 1, since="since", anchor="kept", below="bound").collect()
    assert {(r["snapshot_id"], r["u"], r["v"]) for r in got} == {(0, 0, 7), (1, None, None)} and len(got) == len(star)


def test_ranked_non_edges_are_uniform(spark):
    e = spark.createDataFrame([(0, 0, 1, 0), (1, 1, 3, 0), (2, 2, 4, 0)], "edge_pos bigint, src bigint, tgt bigint, snapshot_id bigint")
    slots = spark.range(3500).select(F.col("id").alias("slot"), F.lit(0).cast("bigint").alias("snapshot_id"))
    got = non_edges(slots, 5, observed_pairs(e, extra=["snapshot_id"]), 1, on=["snapshot_id"], upper=True, max_tries=0)
    n = {(r["u"], r["v"]): r["count"] for r in got.groupBy("u", "v").count().collect()}
    assert set(n) == {(a, b) for b in range(5) for a in range(b)} - {(0, 1), (1, 3), (2, 4)} and all(400 < c < 600 for c in n.values())


def test_product_limit(edges):
    with pytest.raises(ValueError):
        pair_product(edges, edges, 10)


def test_product_without_seen_pairs(spark, monkeypatch):
    """Blocks of targets, broadcast or joined, next to brute force; null ids are in a pool but in no pair."""
    rows = [(1, 4), (4, 1), (2, 9), (9, 9), (3, 7), (5, 2), (1, 4), (None, 8), (6, None)]
    e = spark.createDataFrame(rows, "src bigint, tgt bigint")
    pairs = {(min(p), max(p)) for p in rows if None not in p}
    want = {(a, b) for a in {p[0] for p in rows} - {None} for b in {p[1] for p in rows} - {None} if a != b and (min(a, b), max(a, b)) not in pairs}
    monkeypatch.setattr(sampling, "PRODUCT_ROWS", 3)
    for most in (200_000, 0):
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", most)
        got = pair_product(e, e, without=observed_pairs(e)).filter("src != tgt").collect()
        assert len(got) == len(want) and {(r["src"], r["tgt"]) for r in got} == want
        every = pair_product(e, e).collect()
        assert sorted(r["draw"] for r in every) == list(range(56))


def test_large_products_are_not_refused(spark, tmp_path):
    """1.6 billion pairs: the query has no bound, as its SQL has none."""
    events = spark.range(40_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type")
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert injection.unseen_products(spark, str(tmp_path)).columns == ["src", "tgt"]


def test_selection_falls_back(spark):
    cand = spark.createDataFrame([(i, 1, i) for i in range(10)], "slot bigint, src bigint, tgt bigint")
    seen = lambda ids: spark.createDataFrame([(1, i) for i in ids], "src bigint, tgt bigint")
    slots = lambda df: sorted(r["slot"] for r in df.collect())
    assert len(set(slots(ij.select_unseen(cand, seen(range(4)), 3, "a")))) == 3
    assert slots(ij.select_unseen(cand, seen(range(4)), 8, "a")) == [4, 5, 6, 7, 8, 9]
    more = slots(ij.select_unseen(cand, seen(range(4)), 9, "a", fallbacks=True))
    assert len(more) == 9 and set(more) >= {4, 5, 6, 7, 8, 9} and sum(x < 4 for x in more) == 3
    again = slots(ij.select_unseen(cand, seen([99]), 14, "a", fallbacks=True))
    assert len(again) == 14 and set(again) == set(range(10))
    assert len(set(slots(ij.select_unseen(cand, seen(range(10)), 4, "a", fallbacks=True)))) == 4


def test_rows_are_injected_in_order_or_refused(spark):
    rows = [(i % 7, 10 + (i * 5) % 11, i // 2, i, "test" if i > 30 else "train", [float(i)]) for i in range(60)]
    edges = spark.createDataFrame(rows, "src bigint, tgt bigint, t bigint, edge_pos bigint, split string, msg array<double>")
    out, report = ij.inject_rows(edges, "structural", {"test": 0.2, "train": 0.0}, "s")
    got = out.orderBy("edge_pos").collect()
    assert [(r["t"], r["src"]) for r in got] == sorted((r["t"], r["src"]) for r in got)
    assert {r["split"]: (r["requested"], r["generated"]) for r in report.collect()} == {"test": (5, 5), "train": (0, 0)}
    with pytest.raises(ValueError, match="already"):
        ij.inject_rows(out, "structural", {"test": 0.2})
    # every pair is seen, or all but one of many asked for
    small = edges.filter("src < 2 and tgt < 13")
    free = {(s["src"], t["tgt"]) for s in small.filter("split = 'test'").collect() for t in small.filter("split = 'test'").collect()}
    free -= {(r["src"], r["tgt"]) for r in small.collect()}
    few = ij.generate(small, "structural", 1.0, "test", "s").collect()
    assert {(r["src"], r["tgt"]) for r in few} == free and len(few) == len(free)
    asked = small.filter("split = 'test'").count()
    full = ij.generate(small, "structural", 1.0, "test", "s", fallbacks=True).collect()
    assert len(full) == max(asked, len(free)) and free <= {(r["src"], r["tgt"]) for r in full}
    _, report = ij.inject_rows(small, "structural", {"test": 1.0}, "s")
    assert report.first()["requested"] == asked and report.first()["generated"] == len(free)


@pytest.mark.parametrize("size", [1, 2, 5, 16, 17, 1000, 4096])
def test_permutation_has_every_number_once(spark, size):
    from tgraph.functions.random import permuted, permuted_range

    every = permuted_range(size)
    assert size <= every <= max(4, 4 * size)
    got = [r["x"] for r in permuted(spark.range(every), "id", size, "seed", "x").select("x").collect()]
    assert sorted(got) == list(range(size))
    other = [r["x"] for r in permuted(spark.range(every), "id", size, "other", "x").select("x").collect()]
    assert size < 100 or got != other


def timed(spark, rows, seen, n, last, **kw):
    """Temporal anomalies of (src, tgt, t) rows with times of step 10 up to ``last``."""
    schema = "edge_pos bigint, src bigint, tgt bigint, t bigint"
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema).withColumn("msg", F.array(F.col("edge_pos").cast("double")))
    deltas = spark.createDataFrame([(10, 1, 1.0, 10)], "delta bigint, n bigint, p double, granularity bigint")
    observed = spark.createDataFrame(seen, "src bigint, tgt bigint, t bigint")
    return ij.temporal(e, observed, deltas, n, 0, last, "t", **kw).collect()


def test_temporal_draws_every_free_time_once(spark):
    rows = [(1, 2, 0), (1, 2, 10), (3, 4, 50), (5, 6, 0)]
    # the third pair was seen at every time; one time of the first lies off the lattice, one beyond it
    seen = [(1, 2, 0), (1, 2, 10), (1, 2, 70), (1, 2, 13), (1, 2, 200), (3, 4, 50)] + [(5, 6, t) for t in range(0, 100, 10)]
    free = {(a, b, t) for a, b in ((1, 2), (3, 4)) for t in range(0, 100, 10)} - set(seen)
    assert len(free) == 16
    for n in (1, 5, 15, 16, 17, 40):
        got = timed(spark, rows, seen, n, 95)
        cells = [(r["src"], r["tgt"], r["t"]) for r in got]
        assert len(got) == len(set(cells)) == len({r["slot"] for r in got}) == min(n, 16)
        assert set(cells) <= free
        assert all(r["msg"][0] in ((0.0, 1.0) if r["src"] == 1 else (2.0,)) for r in got)
    assert cells and set(cells) == free
    more = [(r["src"], r["tgt"], r["t"]) for r in timed(spark, rows, seen, 40, 95, fallbacks=True)]
    assert len(more) == 40 and free < set(more) and set(more) - free <= set(seen)


def test_temporal_without_a_free_time(spark):
    seen = [(1, 2, t) for t in range(0, 100, 10)]
    assert timed(spark, [(1, 2, 0)], seen, 3, 95) == []
    again = timed(spark, [(1, 2, 0)], seen, 3, 95, fallbacks=True)
    assert len({r["t"] for r in again}) == 3
    # no multiple of ten lies between, so the first time is the only plausible one
    one = ij.time_lattice(spark.createDataFrame([(10,)], "granularity bigint"), 11, 19)
    assert one == (11, 10, 1)


def test_past_taken_equals_a_list_of_free_cells(spark):
    taken = [(1, 1, i) for i in (0, 1, 2, 5, 9, 11, 12)] + [(2, 2, 4)]
    draws = [(g, g, r, g * 100 + r) for g in (1, 2, 3) for r in range(12)]
    got = ij.past_taken(
        spark.createDataFrame(draws, "src bigint, tgt bigint, rank bigint, slot bigint"),
        spark.createDataFrame(taken, "src bigint, tgt bigint, i bigint"),
    ).collect()
    held = {(g, i) for g, _, i in taken}
    want = {g: [i for i in range(30) if (g, i) not in held] for g in (1, 2, 3)}
    assert {r["slot"]: r["i"] for r in got} == {g * 100 + r: want[g][r] for g in (1, 2, 3) for r in range(12)}
