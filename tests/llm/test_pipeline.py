"""The pipeline's stages on their own inputs, and the registered queries next to their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_minhash import brute
from tests.llm.test_native import brute_hits, brute_lines
from tgraph.session import materialize
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    extra = spark.createDataFrame(
        [(-1, None, None, None, None), (-2, "", "en", "src0", 0), (-3, "same id", "en", "src1", 7), (-3, "same id", "en", "src1", 7), (None, "no id", "en", "src1", 5)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra).withColumn("kept", F.lit(False)).withColumn("_mix", F.lit(1))
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, materialize(stage(spark, out[-1][1], SF), name)))
    return dict(out)


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for name, df in list(stages.items())[1:]:
        assert df.columns[:5] == corpus_pipeline.COLUMNS
        assert name == "mixing" or len(df.columns) == 5
        assert dict(df.dtypes)["n_chars"] == "bigint"


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({i for i, _ in rows(stages[n])} for n in ("input", "toxicity"))
    clean = [i for i in before if labels.get(i) == 0]
    toxic = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)
    assert sum(i in after for i in toxic) <= 0.3 * len(toxic)


def test_line_dedup_stage(stages):
    before = [(i, s, t) for i, t, s in stages["toxicity"].select("doc_id", "text", "source").collect()]
    assert sorted(rows(stages["line_dedup"]), key=str) == sorted([(i, t) for i, t, _ in brute_lines(before)], key=str)
    wrong = stages["line_dedup"].where("text is not null and n_chars <> length(text)").join(stages["toxicity"], ["doc_id", "text"], "left_anti")
    assert wrong.count() == 0


def test_near_dedup_stage(stages):
    before = rows(stages["line_dedup"])
    component = brute(before, 5)
    assert sorted({i for i in component.values()}) == sorted(i for i, _ in rows(stages["near_dedup"]) if i is not None)
    assert sum(i is None for i, _ in rows(stages["near_dedup"])) == sum(i is None for i, _ in before)


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = rows(stages["near_dedup"])
    clean = [d for d, hit in zip(before, brute_hits(before, items)) if not hit[-1]]
    assert sorted(rows(stages["decontamination"]), key=str) == sorted(clean, key=str)


def test_mixing_stage(stages):
    before, after = stages["decontamination"], stages["mixing"]
    assert set(rows(after)) <= set(rows(before)) and 0 < after.count() < before.count()
    assert after.where("probability is null or probability <= 0 or probability > 1").count() == 0


def test_run_is_the_stages_in_order(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = materialize(stage(spark, want, SF), "stage")
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    verdict = compare(got, db.execute(entry.oracle_sql()[name]).df())
    assert verdict.startswith("ok"), verdict


def test_every_operator_has_a_query():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
