"""Readers for edge lists, feature tables and result files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tgraph.operators.ordering import global_position
from tgraph.operators.report import RESULT_SCHEMA
from tgraph.operators.structure import canonical, check_columns, drop_self_loops, flip, reindex_nodes
from tgraph.operators.timeline import continued_snapshots
from tgraph.plans.graph import TemporalGraph

EDGE_TABLES = ("edge_types", "edge_labels", "edge_features_num", "edge_features_cat", "edge_features_str")
NODE_TABLES = (
    "node_types", "node_labels", "node_timestamps", "node_features_num", "node_features_cat", "node_features_str",
)


def pivot_features(df: DataFrame, id_col: str, kind: str, prefix: str = "feat_") -> DataFrame:
    """Long (id, feature_id, value) to one column per feature; others pass.

    Columns are named ``<prefix><feature_id>_<kind>``; one per feature, so their
    number is that of the table's features. Of repeated values the largest counts.
    """
    if not {id_col, "feature_id", "value"} <= set(df.columns):
        return df
    ids = sorted(r[0] for r in df.select("feature_id").distinct().collect())
    # the largest of repeated values, so that a rerun gives the same table
    wide = df.groupBy(id_col).pivot("feature_id", ids).agg(F.max("value"))
    return wide.select(id_col, *[F.col(f"`{i}`").alias(f"{prefix}{i}_{kind}") for i in ids])


def long_features(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], kind: str = "double"
) -> DataFrame:
    """Wide feature columns to (ids, feature_id, value), values cast to ``kind``."""
    cast = df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), "feature_id", "value")


def join_features(base: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join side tables one after another."""
    out = base
    for t in tables:
        out = out.join(t, key, "left")
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def load_dataset(
    spark: SparkSession, directory: str, name: str, prefix: str = "feat_", time_col: str = "timestamp"
) -> TemporalGraph:
    """A structured dataset folder: edges plus whatever side tables exist.

    Rows of later node tables that the first one lacks are dropped.
    """
    path = f"{directory}/{name}"
    if not _exists(spark, f"{path}/edges.parquet"):
        raise FileNotFoundError(f"{path}/edges.parquet")
    edges = spark.read.parquet(f"{path}/edges.parquet")
    check_columns(edges, "edge_id", "src", "tgt", time_col)

    def sides(names: Sequence[str], key: str) -> list[DataFrame]:
        found = []
        for n in names:
            if _exists(spark, f"{path}/{n}.parquet"):
                found.append(pivot_features(spark.read.parquet(f"{path}/{n}.parquet"), key, n.rsplit("_", 1)[1], prefix))
        return found

    edges = join_features(edges, sides(EDGE_TABLES, "edge_id"), "edge_id")
    nodes = sides(NODE_TABLES, "node_id")
    frame = join_features(nodes[0], nodes[1:], "node_id") if nodes else None
    return TemporalGraph(edges, frame, t=time_col, metadata={"dataset_name": name})


def load_custom_dataset(
    spark: SparkSession,
    directory: str,
    src: str = "src",
    tgt: str = "tgt",
    t: str = "t",
    label: str = "label",
) -> TemporalGraph:
    """train.csv and test.csv as one edge table with a split and an edge id.

    A missing label is 0; a column only one file has is null in the other.
    """
    parts = []
    for order, split in enumerate(("train", "test")):
        df = spark.read.csv(f"{directory}/{split}.csv", header=True, inferSchema=True)
        check_columns(df, src, tgt, t)
        if label not in df.columns:
            df = df.withColumn(label, F.lit(0))
        parts.append(df.withColumns({"split": F.lit(split), "_o": F.lit(order)}))
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    both = both.withColumnsRenamed({src: "src", tgt: "tgt", t: "t", label: "label"})
    # the row hash makes the order of equal edges repeatable
    key = F.xxhash64(*[c for c in both.columns if c != "_o"])
    placed = global_position(both.withColumn("_h", key), ["_o", "t", "src", "tgt", "_h"], "edge_id")
    return TemporalGraph(placed.drop("_o", "_h"))


def load_flipped(
    spark: SparkSession, directory: str, size: int, src: str = "src", tgt: str = "tgt", t: str = "t", label: str = "label"
) -> TemporalGraph:
    """train.csv and test.csv whose label 1 means normal, ready for snapshots.

    Labels are flipped, both files get one numbering of nodes 0..N-1 in the order
    of their ids, and rows are cut into snapshots of ``size`` that do not cross
    from train to test.
    """
    graph = load_custom_dataset(spark, directory, src, tgt, t, label)
    edges = graph.edges.withColumn("label", flip("label"))
    edges = reindex_nodes(edges)[0]
    edges = continued_snapshots(edges, size, pos="edge_id")
    return graph.with_edges(edges)


def preprocess(edges: DataFrame, undirected: bool = True) -> DataFrame:
    """Parsed edges (src, tgt, t, ...) made canonical: no self-loops, smaller id
    first, the earliest of repeated pairs, nodes numbered 0..N-1, in time order
    with ``edge_id`` as the position."""
    kept = drop_self_loops(edges)
    kept = canonical(kept) if undirected else kept
    key = F.xxhash64(*kept.columns)
    placed = global_position(kept.withColumn("_h", key), ["t", "src", "tgt", "_h"], "_p").drop("_h")
    first = placed.groupBy("src", "tgt").agg(F.min("_p").alias("_p"))
    kept = reindex_nodes(placed.join(first, ["src", "tgt", "_p"]))[0]
    return global_position(kept, ["_p"], "edge_id").drop("_p")


PROVENANCE = (
    "event_id string, src string, tgt string, kind string, t bigint, size bigint, host string, process string, path string, "
    "sequence bigint, label int, weight double, note string, extra1 string, extra2 string"
)
PROVENANCE_COLUMNS = "event_id src tgt kind t size host process path sequence label weight".split()


def read_provenance(spark: SparkSession, edges: str, nodes: str) -> TemporalGraph:
    """Provenance tables: 12 of 15 edge columns, and nodes with attributes.

    Node attributes are categorical (``type``) and text (``name``, ``command``).
    Ids are texts; they are numbered in their order, and edges keep the time order.
    """
    e = spark.read.schema(PROVENANCE).csv(edges, header=True).select(*PROVENANCE_COLUMNS)
    n = spark.read.schema("uuid string, type string, name string, command string").csv(nodes, header=True)
    ids = n.select("uuid").unionByName(e.select(F.col("src").alias("uuid"))).unionByName(e.select(F.col("tgt").alias("uuid"))).distinct()
    ids = global_position(ids, ["uuid"], "node_id")
    for end in ("src", "tgt"):
        own = ids.select(F.col("uuid").alias(end), F.col("node_id").alias(f"_{end}"))
        e = e.join(own, end).drop(end).withColumnRenamed(f"_{end}", end)
    placed = global_position(e, ["t", "sequence", "event_id"], "edge_id")
    return TemporalGraph(placed, ids.join(n, "uuid", "left"))


def assemble_arrays(features: DataFrame, labels: DataFrame, times: DataFrame, edges: DataFrame) -> TemporalGraph:
    """A bundle of arrays as tables: node features (node_id, x), labels (node_id,
    label) and times (node_id, timestamp), and edges (edge_id, src, tgt, edge_type).

    An edge's time is the later of its ends' times.
    """
    nodes = features.join(labels, "node_id", "left").join(times, "node_id", "left")
    for end in ("src", "tgt"):
        own = times.select(F.col("node_id").alias(end), F.col("timestamp").alias(f"_{end}"))
        edges = edges.join(own, end, "left")
    edges = edges.withColumn("t", F.greatest("_src", "_tgt")).drop("_src", "_tgt")
    return TemporalGraph(edges, nodes)


def read_edge_list(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    columns: Mapping[str, str],
    sep: str = ",",
    header: bool = False,
    comment: str | None = None,
    null: str | None = None,
) -> DataFrame:
    """Delimited edges (also gzipped): only the needed columns, renamed.

    ``columns`` maps column names of ``schema`` to output names; ``comment``
    skips preamble lines that start with it; ``null`` is the missing marker.
    """
    options = {"sep": sep, "header": header, "ignoreLeadingWhiteSpace": True}
    if comment:
        options["comment"] = comment
    if null is not None:
        options["nullValue"] = null
    df = spark.read.schema(schema).options(**options).csv(path)
    return df.select(*[F.col(c).alias(n) for c, n in columns.items()])


def read_interactions(spark: SparkSession, path: str, features: int, header: bool = True) -> DataFrame:
    """Interaction log: user, item, time, label, then feature columns.

    Features are packed into one array.
    """
    names = [f"f{i}" for i in range(features)]
    schema = "src bigint, tgt bigint, t double, label int, " + ", ".join(f"{n} double" for n in names)
    df = spark.read.schema(schema).csv(path, header=header, nullValue="-")
    packed = F.array(*names) if names else F.array().cast("array<double>")
    return df.select("src", "tgt", "t", "label", packed.alias("msg"))


def read_actions(spark: SparkSession, directory: str) -> DataFrame:
    """Action logs in three tab-separated tables joined by the action id."""
    def tsv(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).csv(f"{directory}/{name}", sep="\t", header=True)

    actions = tsv("actions.tsv", "edge_id bigint, src bigint, tgt bigint, t double")
    features = tsv(
        "action_features.tsv", "edge_id bigint, FEATURE0 double, FEATURE1 double, FEATURE2 double, FEATURE3 double"
    )
    labels = tsv("action_labels.tsv", "edge_id bigint, label int")
    long = long_features(features, ["edge_id"], [c for c in features.columns if c != "edge_id"])
    long = long.withColumn("feature_id", F.regexp_extract("feature_id", r"(\d+)", 1).cast("bigint"))
    wide = pivot_features(long, "edge_id", "num")
    return join_features(actions, [wide, labels], "edge_id")


# no escape character but the doubled quote, line ends kept as they are, and an empty text told from an absent one
REVIEW_CSV = {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review rows with a parsed date, a 0/1 label and the text as a feature.

    Texts come back as they are if they are quoted, ``\\N`` stands for an absent one.
    """
    schema = "user_id bigint, prod_id bigint, rating double, label int, date string, text string"
    df = spark.read.schema(schema).csv(path, multiLine=True, **REVIEW_CSV)
    label = F.when(F.col("label") == -1, 1).when(F.col("label") == 1, 0).otherwise(F.col("label"))
    return df.select(
        F.col("user_id").alias("src"), F.col("prod_id").alias("tgt"), F.to_date("date").alias("t"),
        label.alias("label"), "rating", "text",
    )


PRODUCT_REVIEW = (
    "rating double, title string, text string, asin string, parent_asin string, user_id string, "
    "timestamp bigint, helpful_vote bigint, verified_purchase boolean"
)
PRODUCT_META = "parent_asin string, title string, features array<string>, description array<string>, categories array<string>"


def read_ndjson(spark: SparkSession, path: str, schema: str = PRODUCT_REVIEW) -> DataFrame:
    """One JSON object per line, gzipped or not, with a fixed schema."""
    return spark.read.schema(schema).json(path)


def read_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Published result tables of all methods as one table."""
    return spark.read.schema(RESULT_SCHEMA).csv(paths, header=True)


def read_benchmarks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_sidecars(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Per-run array files as rows; the file is named method__dataset.json, or
    holds lines with that name as ``slug``."""
    schema = (
        "per_snapshot_latency_ms array<double>, per_snapshot_edges array<bigint>, "
        "per_snapshot_mean_degree array<double>, per_snapshot_span_sec array<double>"
    )
    df = spark.read.schema(schema + ", slug string").option("multiLine", multi_line).json(path)
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    df = df.withColumn("slug", F.coalesce("slug", slug))
    parts = F.split("slug", "__")
    zipped = F.arrays_zip(
        "per_snapshot_latency_ms", "per_snapshot_edges", "per_snapshot_mean_degree", "per_snapshot_span_sec"
    )
    rows = df.select(
        F.get(parts, F.lit(0)).alias("method"), F.get(parts, F.lit(1)).alias("dataset"),
        F.posexplode(zipped).alias("seq", "z"),
    )
    return rows.select(
        "method", "dataset", F.col("seq").cast("bigint").alias("seq"),
        F.col("z.per_snapshot_latency_ms").alias("latency_ms"),
        F.col("z.per_snapshot_edges").alias("num_edges"),
        F.col("z.per_snapshot_mean_degree").alias("mean_degree"),
        F.col("z.per_snapshot_span_sec").alias("span"),
    )
