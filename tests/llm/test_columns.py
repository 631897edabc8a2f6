"""Columns of the given table that are called like an operator's inner ones pass unchanged."""

from pyspark.sql import functions as F

from tgraph.llm import decontam, linededup, mixing, toxicity
from tgraph.llm.columns import put_back, set_aside


def test_only_clashing_columns_are_set_aside(spark):
    table = spark.createDataFrame([(1, 2, 3, 4)], "`_P` int, b int, `_P_0` int, c int")
    held, away = set_aside(table, ("_p", "x"))
    assert away == {"_P": "_P_1"} and held.columns == ["_P_1", "b", "_P_0", "c"]
    assert put_back(held, away).columns == table.columns
    assert set_aside(table, ("y",)) == (table, {})


def clashing(spark, names):
    words = "one two three four five six seven eight nine ten eleven"
    rows = [(i, "h", "en", f"menu\n{words}\nown line {i}" if i % 2 else f"you idiot {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    return docs, docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})


def same(plain, clashed, names, result):
    got = {r.doc_id: r for r in clashed.collect()}
    want = {r.doc_id: r for r in plain.collect()}
    assert all(got[i][n] == f"{n}{i}" for i in want for n in names)
    assert {i: (r.text, r[result]) for i, r in got.items()} == {i: (r.text, r[result]) for i, r in want.items()}


def test_line_dedup(spark):
    names = ["_host", "Boilerplate", "_all", "_rest", "line", "page"]
    docs, more = clashing(spark, names)
    same(linededup.drop_boilerplate(docs), linededup.drop_boilerplate(more), names, "_lines")
    held = docs.withColumnRenamed("source", "_host")  # a column that is read may have such a name, too
    assert linededup.drop_boilerplate(held, host_col="_host").columns == ["doc_id", "_host", "lang", "text", "_lines"]


def test_decontamination(spark):
    names = ["_key", "_of", "_hits", "_text", "words", "doc_key", "item_id"]
    docs, more = clashing(spark, names)
    items = spark.createDataFrame([("b", "one two three four five six seven eight nine ten")], "item_id string, text string")
    plain = decontam.contamination(docs, items)
    assert plain.where("_contamination.contaminated").count() == 6
    same(plain, decontam.contamination(more, items), names, "_contamination")


def test_mixing(spark):
    names = ["_p", "_c_source", "_C_topic", "topic", "weight", "tokens", "probability"]
    docs, more = clashing(spark, names)
    same(mixing.mix(docs), mixing.mix(more), names, "_mix")


def test_toxicity(spark):
    names = ["_features", "_raw", "_raw1", "_p", "_class", "_level", "_score", "features", "toxic"]
    docs, more = clashing(spark, names)
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    same(toxicity.score(docs, labels), toxicity.score(more, labels), names, "_toxicity")
