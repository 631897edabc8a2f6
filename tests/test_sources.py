import gzip
import json

import pytest
from pyspark.sql import functions as F

from tgraph.operators import features as ft
from tgraph.operators import report as rp
from tgraph.plans.graph import TemporalGraph
from tgraph.plans.steps import Chain
from tgraph.sources import readers as rd
from tgraph.sources import writers as wr


def test_edge_lists(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("1,2,5,100\n2,3,-1,200\n")
    got = rd.read_edge_list(spark, str(tmp_path / "a.csv.gz"), "a bigint, b bigint, w int, t bigint", {"a": "src", "b": "tgt", "t": "t"})
    assert sorted(map(tuple, got.collect())) == [(1, 2, 100), (2, 3, 200)]
    (tmp_path / "b.txt").write_text("% graph\n% sizes\n1 2 1 7\n3 4 1 -\n")
    got = rd.read_edge_list(spark, str(tmp_path / "b.txt"), "a bigint, b bigint, w int, t bigint", {"a": "src", "b": "tgt", "t": "t"}, sep=" ", comment="%", null="-")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 7), (3, 4, None)]


def test_interactions_actions_reviews(spark, tmp_path):
    (tmp_path / "log.csv").write_text("user,item,ts,label,f0,f1\n0,1,5.0,0,0.1,0.2\n1,1,6.0,1,-,0.4\n")
    rows = rd.read_interactions(spark, str(tmp_path / "log.csv"), 2).orderBy("t").collect()
    assert rows[0]["msg"] == [0.1, 0.2] and rows[1]["msg"] == [None, 0.4]
    (tmp_path / "actions.tsv").write_text("id\tu\ti\tt\n0\t1\t2\t3.0\n1\t1\t3\t4.0\n")
    (tmp_path / "action_features.tsv").write_text("id\ta\tb\tc\td\n0\t1\t2\t3\t4\n1\t5\t6\t7\t8\n")
    (tmp_path / "action_labels.tsv").write_text("id\tl\n0\t0\n1\t1\n")
    a = rd.read_actions(spark, str(tmp_path)).orderBy("edge_id").collect()
    assert (a[1]["feat_0_num"], a[1]["feat_3_num"], a[1]["label"]) == (5.0, 8.0, 1)
    (tmp_path / "r.csv").write_text('u,p,r,l,d,t\n1,2,5.0,-1,2014-01-02,"fine, really"\n1,3,1.0,1,2014-01-03,bad\n')
    r = rd.read_reviews(spark, str(tmp_path / "r.csv")).orderBy("t").collect()
    assert [x["label"] for x in r] == [1, 0] and r[0]["text"] == "fine, really" and r[0]["t"].year == 2014
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(json.dumps({"rating": 4.0, "user_id": "u", "parent_asin": "p", "timestamp": 5, "verified_purchase": True}) + "\n")
    assert rd.read_ndjson(spark, str(tmp_path / "x.jsonl.gz")).first()["user_id"] == "u"


def test_dataset_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2, 5), (1, 2, 3, 6)], "edge_id bigint, src bigint, tgt bigint, timestamp bigint")
    num = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0)], "edge_id bigint, feature_id string, value double")
    labels = spark.createDataFrame([(1, 1)], "edge_id bigint, label int")
    types = spark.createDataFrame([(1, 0), (2, 0)], "node_id bigint, node_type int")
    extra = spark.createDataFrame([(2, 1), (9, 1)], "node_id bigint, label int")
    wr.write_dataset(
        {"edges": edges, "edge_features_num": num, "edge_labels": labels, "node_types": types, "node_labels": extra},
        str(tmp_path), "d",
    )
    g = rd.load_dataset(spark, str(tmp_path), "d")
    rows = g.edges.orderBy("edge_id").collect()
    assert (rows[0]["feat_a_num"], rows[0]["feat_b_num"], rows[0]["label"]) == (1.0, 2.0, None)
    assert (rows[1]["feat_a_num"], rows[1]["feat_b_num"], rows[1]["label"]) == (3.0, None, 1)
    assert {(r["node_id"], r["label"]) for r in g.nodes.collect()} == {(1, None), (2, 1)}
    assert g.num_nodes() == 4
    packed = wr.pack_graph(g).edges.orderBy("edge_id").collect()
    assert packed[0]["msg"] == [1.0, 2.0]
    run = Chain.from_config([{"name": "Load", "params": {"directory": str(tmp_path), "name": "d"}}, {"name": "NormalizeTime"}], spark=spark).run()
    assert run.metadata["is_timestamp_normalized"] is True
    with pytest.raises(FileNotFoundError):
        rd.load_dataset(spark, str(tmp_path), "none")


def test_custom_dataset(spark, tmp_path):
    (tmp_path / "train.csv").write_text("src,tgt,t,x\n1,2,3,0.5\n1,3,4,0.6\n")
    (tmp_path / "test.csv").write_text("src,tgt,t,label\n2,3,5,1\n")
    rows = rd.load_custom_dataset(spark, str(tmp_path)).edges.orderBy("edge_id").collect()
    assert [(r["edge_id"], r["split"], r["label"], r["x"]) for r in rows] == [(0, "train", 0, 0.5), (1, "train", 0, 0.6), (2, "test", 1, None)]


def test_variants(spark, tmp_path, graph):
    name = wr.variant_name("burst", {"val": 0.1, "test": 0.1}, "small")
    assert name == "burst_tr0.0_v0.1_te0.1_dursmall"
    calls = []

    def build():
        calls.append(1)
        e = graph([(0, 1, 2), (1, 2, 3)]).withColumn("group_id", F.col("edge_pos"))
        return TemporalGraph(e, metadata={"type": "burst"})

    for _ in range(2):
        g = wr.load_variant(spark, str(tmp_path), "d", name, build)
        assert g.edges.count() == 2 and g.metadata["type"] == "burst"
    assert len(calls) == 1
    row = spark.read.json(f"{tmp_path}/dataset=d/variant={name}/metadata").first()
    assert (row["anomaly_groups"], row["anomalous_edges"], row["num_nodes"]) == (1, 1, 3)
    assert wr.parameter_hash({"a": 1, "b": 2}) == wr.parameter_hash({"b": 2, "a": 1})


def test_result_files(spark, tmp_path):
    (tmp_path / "m1.csv").write_text("method,dataset,anom_type,anom_ratio,anom_duration,auprc,rocauc\nm1,d,burst,0.1,1,,0.7\n")
    (tmp_path / "m2.csv").write_text("method,dataset,anom_type,anom_ratio,anom_duration,auprc,rocauc\nm2,d,burst,0.1,0.5,0.3,0.9\n")
    r = rd.read_results(spark, str(tmp_path / "*.csv"))
    assert r.count() == 2 and r.filter("auprc is null").count() == 1
    board = rp.leaderboard(r, {"dataset": "d"}, "rocauc", ["method"], 1)
    assert board.first()["method"] == "m2"
    side = {"per_snapshot_latency_ms": [1.0, 2.0], "per_snapshot_edges": [3, 4], "per_snapshot_mean_degree": [1.5, 2.5], "per_snapshot_span_sec": [None, 1.0]}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "gcn__enron.json").write_text(json.dumps(side, indent=1))
    rows = rd.read_sidecars(spark, str(tmp_path / "s")).orderBy("seq").collect()
    assert (rows[1]["method"], rows[1]["dataset"], rows[1]["num_edges"], rows[1]["span"]) == ("gcn", "enron", 4, 1.0)


def test_reports_on_the_driver():
    assert rp.merge_config({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}, {"b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    space = {"a": [1, 2], "b": [3, 4, 5]}
    assert len(rp.search_space(space)) == 6 and len(rp.search_space(space, 2, 1)) == 2
    assert rp.search_space(space, 2, 1) == rp.search_space(space, 2, 1)


def test_grid(spark):
    g = rp.experiment_grid(spark, ["a", "b"], ["burst"], [0.1, 0.2], [0.5], {"a": 6000}, 2000)
    assert g.count() == 4 and g.filter("dataset = 'a'").first()["window_size"] == 6000


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    s = ft.StandardScaler().fit(df, ["a", "b"])
    assert sorted(r["b"] for r in s.transform(df).collect()) == [0.0, 0.0]
    m = ft.MinMaxScaler(-1.0, 1.0).fit(df, ["a", "b"])
    assert sorted(map(tuple, m.transform(df).collect())) == [(-1.0, -1.0), (1.0, -1.0)]
    for norm in (s, m):
        assert sorted(map(tuple, norm.inverse_transform(norm.transform(df)).collect())) == [(1.0, 5.0), (3.0, 5.0)]
    with pytest.raises(ValueError):
        ft.MinMaxScaler(1.0, 1.0)
    with pytest.raises(RuntimeError):
        ft.StandardScaler().transform(df)
    with pytest.raises(ValueError):
        ft.StandardScaler().fit(df, ["nope"])


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "the cat sat, Cat!"), (2, "dog und Übung"), (3, None)], "id int, text string")
    wide = ft.TextVectorizer("bow", 3).fit(df, ["text"]).transform(df).orderBy("id").collect()
    assert wide[0]["text_bow_cat"] == 2.0 and wide[2]["text_bow_cat"] == 0.0
    unit = ft.TextVectorizer("tfidf", 10).fit(df, ["text"]).transform(df).orderBy("id").collect()
    assert sum(v * v for k, v in unit[1].asDict().items() if k.startswith("text_")) == pytest.approx(1.0)
    assert unit[1]["text_tfidf_übung"] > 0


def test_text_vectors_of_all_words(spark):
    train = spark.createDataFrame([("the cat sat, Cat!", "x1"), ("dog und Übung", None), (None, "y2")], "text string, note string")
    df = spark.createDataFrame([(1, "cat cat dog newword", "y2", 5), (1, "cat cat dog newword", "y2", 5), (2, None, "", 6), (3, "the", "zz", 7)], "id int, text string, note string, row_0 int")
    bow = ft.TextVectorizer("bow", None).fit(train, ["text", "note"])
    out = bow.transform(df)
    assert out.columns == ["id", "row_0", "text_bow", "note_bow"]
    assert sorted(map(tuple, out.collect()), key=str) == [
        (1, 5, {"cat": 2.0, "dog": 1.0}, {"y2": 1.0}), (1, 5, {"cat": 2.0, "dog": 1.0}, {"y2": 1.0}), (2, 6, {}, {}), (3, 7, {}, {}),
    ]
    # of all words, as of as many columns as there are words
    wide = ft.TextVectorizer("tfidf", 10).fit(train.select("text"), ["text"]).transform(df.select("text")).first().asDict()
    long = ft.TextVectorizer("tfidf", None).fit(train.select("text"), ["text"]).transform(df.select("text")).where("size(text_tfidf) > 0").first()[0]
    assert {f"text_tfidf_{w}": v for w, v in long.items()} == pytest.approx({k: v for k, v in wide.items() if v})
    assert ft.TextVectorizer("bow", None).fit(train.where("false"), ["text"]).transform(df.where("false")).count() == 0


def test_review_texts_come_back_as_they_are(spark, tmp_path):
    texts = ["a,b", "", None, "\\", 'end \\"', "cr\rlf\r\nnl\n", '"', '""', " lead", "trail ", "\\N?", "\n", "\r", "x\\\\", "é\t"]
    rows = [(i, 1, 2.0, -1, "2020-01-02", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "user_id bigint, prod_id bigint, rating double, label int, date string, text string")
    df.coalesce(1).write.csv(str(tmp_path / "r"), quoteAll=True, **rd.REVIEW_CSV)
    got = {r["src"]: r["text"] for r in rd.read_reviews(spark, str(tmp_path / "r")).collect()}
    assert got == dict(enumerate(texts))
