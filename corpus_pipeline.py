"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
documents. All but the last return the columns of ``documents``; the last adds
each document's topic and the probability with which it was kept. Other columns
of the input are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tgraph.llm import decontam, linededup, minhash, mixing, toxicity
from tgraph.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays below 0.3; rows without text stay."""
    scored = toxicity.score(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))
    return scored.where("_toxicity.predicted = 0").select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; ``n_chars`` follows the text."""
    out = linededup.drop_boilerplate(docs.select(*COLUMNS))
    changed = F.col("_lines.dropped") > 0
    n_chars: Column = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more.

    The smallest doc_id of a group stays. Of rows that repeat a doc_id the least
    one, by text and the other columns, stays; rows without a doc_id all stay.
    """
    docs = docs.select(*COLUMNS)
    judged = minhash.near_duplicates(docs, k=5, similarity=80)
    removed = materialize(judged.where("not kept").select("doc_id").distinct(), "removed")
    kept = docs.join(removed, "doc_id", "left_anti").select(*COLUMNS)
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    repeated = materialize(ids.where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).union(one.select("doc_id", "row.*").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark."""
    judged = decontam.contamination(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))
    return judged.where("not _contamination.contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents, raked to targets by source, language and topic."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("_mix.kept")
    return mixed.select(*COLUMNS, "_mix.topic", F.round("_mix.probability", 6).alias("probability"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# The trees of the first stage have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``, each written and reread."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
