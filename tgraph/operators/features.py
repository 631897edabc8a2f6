"""Feature scaling and text vectors, fitted on training rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.functions.arrays import let
from tgraph.functions.text import STOP_WORDS, tokens, word_counts
from tgraph.operators.structure import check_columns
from tgraph.session import materialize, maybe_broadcast

EPSILON = 1e-9


class Normalizer:
    """fit / transform / inverse_transform over a list of columns."""

    columns: tuple[str, ...] = ()

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Normalizer:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _ready(self, df: DataFrame) -> None:
        if not self.columns:
            raise RuntimeError(f"{type(self).__name__} must be fitted first")
        check_columns(df, *self.columns)


@dataclass
class StandardScaler(Normalizer):
    """(x - mean) / sample deviation; deviations up to 1e-9 count as 1."""

    columns: tuple[str, ...] = ()
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> StandardScaler:
        check_columns(df, *columns)
        self.columns = tuple(columns)
        # one pass for all columns
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).first()
        self.mean = {c: float(row[f"m_{c}"]) for c in columns}
        self.std = {c: float(row[f"s_{c}"] or 0.0) for c in columns}
        self.std = {c: s if s > EPSILON else 1.0 for c, s in self.std.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._ready(df)
        return df.withColumns(
            {c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c]) for c in self.columns}
        )

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._ready(df)
        return df.withColumns(
            {c: F.col(c) * F.lit(self.std[c]) + F.lit(self.mean[c]) for c in self.columns}
        )


@dataclass
class MinMaxScaler(Normalizer):
    """Scale to a range; constant columns become its lower end."""

    low: float = 0.0
    high: float = 1.0
    columns: tuple[str, ...] = ()
    data_min: dict[str, float] = field(default_factory=dict)
    data_max: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.low >= self.high:
            raise ValueError("the lower end must be below the upper end")

    def fit(self, df: DataFrame, columns: Sequence[str]) -> MinMaxScaler:
        check_columns(df, *columns)
        self.columns = tuple(columns)
        row = df.agg(
            *[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]
        ).first()
        self.data_min = {c: float(row[f"a_{c}"]) for c in columns}
        self.data_max = {c: float(row[f"b_{c}"]) for c in columns}
        return self

    def _span(self, c: str) -> float:
        return self.data_max[c] - self.data_min[c]

    def transform(self, df: DataFrame) -> DataFrame:
        self._ready(df)
        size = self.high - self.low

        def scaled(c: str) -> Column:
            if self._span(c) <= EPSILON:
                return F.lit(self.low)
            share = (F.col(c) - F.lit(self.data_min[c])) / F.lit(self._span(c))
            return share * F.lit(size) + F.lit(self.low)

        return df.withColumns({c: scaled(c) for c in self.columns})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._ready(df)
        size = self.high - self.low

        def restored(c: str) -> Column:
            if self._span(c) <= EPSILON:
                return F.lit(self.data_min[c])
            share = (F.col(c) - F.lit(self.low)) / F.lit(size)
            return share * F.lit(self._span(c)) + F.lit(self.data_min[c])

        return df.withColumns({c: restored(c) for c in self.columns})


@dataclass
class TextVectorizer(Normalizer):
    """Counts (``bow``) or tf-idf of the most frequent words, one column each.

    Output columns are ``<column>_<kind>_<word>``.  On transform a text is
    split once and counted inside its row, without a shuffle.

    With ``max_features`` None every word of the fitted texts counts. The
    vocabulary is then a table that is joined by word, nothing of it passes
    through the driver, and the output is one column ``<column>_<kind>``, a map
    from the words that a text has to their values; null, empty and wholly
    unknown texts get an empty map. Rows that repeat are counted each.
    """

    kind: str = "bow"
    max_features: int | None = 64
    stop_words: tuple[str, ...] = STOP_WORDS
    columns: tuple[str, ...] = ()
    vocabulary: dict[str, list[str]] = field(default_factory=dict)
    idf: dict[str, dict[str, float]] = field(default_factory=dict)
    words: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("bow", "tfidf"):
            raise ValueError("kind must be bow or tfidf")

    def fit(self, df: DataFrame, columns: Sequence[str]) -> TextVectorizer:
        check_columns(df, *columns)
        self.columns = tuple(columns)
        for c in columns:
            texts = df.filter(F.col(c).isNotNull()).select(tokens(c, self.stop_words).alias("w"))
            n = texts.count()
            if self.max_features is None:
                # only words and partial counts are shuffled
                each = texts.select(F.inline(word_counts(F.col("w")))).groupBy("word")
                each = each.agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
                idf = F.log(F.lit(float(1 + n)) / (1 + F.col("df"))) + 1.0
                self.words[c] = materialize(each.withColumn("idf", idf), "vocabulary")
                continue
            # words of one text are counted together first, then over texts
            marked = texts.withColumn("_t", F.monotonically_increasing_id())
            per_text = marked.select("_t", F.explode("w").alias("word")).groupBy("_t", "word").agg(
                F.count("*").alias("tf")
            )
            all_words = per_text.groupBy("word").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
            top = all_words.orderBy(F.col("total").desc(), "word").limit(self.max_features).collect()
            words = sorted(r["word"] for r in top)
            self.vocabulary[c] = words
            self.idf[c] = {r["word"]: math.log((1 + n) / (1 + r["df"])) + 1.0 for r in top}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._ready(df)
        if self.max_features is None:
            return self._sparse(df)
        out = df
        for c in self.columns:
            words = self.vocabulary[c]
            listed = F.array(*[F.lit(w) for w in words])

            def counts(found: Column, listed: Column = listed) -> Column:
                return F.transform(
                    listed, lambda word: F.size(F.filter(found, lambda x: x == word)).cast("double")
                )

            known = F.filter(tokens(c, self.stop_words), lambda w: w.isin(*words))
            vector = let(known, lambda found: counts(found))
            if self.kind == "tfidf":
                idf = F.array(*[F.lit(self.idf[c][w]) for w in words])
                vector = let(F.zip_with(vector, idf, lambda x, y: x * y), unit_length)
            out = out.withColumn("_v", vector)
            named = {f"{c}_{self.kind}_{w}": F.get("_v", F.lit(i)) for i, w in enumerate(words)}
            out = out.withColumns(named).drop("_v", c)
        return out

    def _sparse(self, df: DataFrame) -> DataFrame:
        # written once, so that a retried task cannot number the rows anew
        row = next(n for i in range(len(df.columns) + 1) if (n := f"row_{i}") not in df.columns)
        out = numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "texts")
        for c in self.columns:
            counted = numbered.select(row, F.inline(word_counts(tokens(c, self.stop_words))))
            value = F.col("tf") * F.col("idf") if self.kind == "tfidf" else F.col("tf")
            known = counted.join(maybe_broadcast(self.words[c].select("word", "idf")), "word").select(row, "word", value.alias("value"))
            # sorted by word, so that sums of squares do not depend on the order of arrival
            pairs = F.array_sort(F.collect_list(F.struct("word", "value")))
            per_row = known.groupBy(row).agg(pairs.alias("pairs"))
            values = F.col("pairs.value")
            values = unit_length(values) if self.kind == "tfidf" else values
            per_row = per_row.select(F.col(row), F.map_from_arrays("pairs.word", values).alias("weights"))
            empty = F.create_map().cast("map<string,double>")
            joined = out.drop(c) if c in out.columns else out
            out = joined.join(per_row, row, "left").withColumn(f"{c}_{self.kind}", F.coalesce("weights", empty)).drop("weights")
        return out.drop(row)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError("the text cannot be recovered from word weights")


def unit_length(v: Column) -> Column:
    """A vector over its length; zeros stay zeros."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return let(
        F.sqrt(square),
        lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))),
    )


def fit_on_train(df: DataFrame, specs: Sequence[tuple[Normalizer, Sequence[str]]]) -> list[Normalizer]:
    """Fit each normaliser on train rows only (all rows without a split)."""
    train = df.filter(F.col("split") == "train") if "split" in df.columns else df
    return [norm.fit(train, cols) for norm, cols in specs]


def normalize_features(
    edges: DataFrame,
    nodes: DataFrame | None,
    specs: Sequence[Mapping[str, Any]],
) -> tuple[DataFrame, DataFrame | None]:
    """Apply specs ``{normalizer, columns, target}``; no target means edges."""
    for spec in specs:
        target = spec.get("target") or "edge"
        if target not in ("edge", "node"):
            raise ValueError(f"unknown target '{target}'")
        table = edges if target == "edge" else nodes
        if table is None:
            raise ValueError("there is no node table")
        (fitted,) = fit_on_train(table, [(spec["normalizer"], spec["columns"])])
        table = fitted.transform(table)
        edges, nodes = (table, nodes) if target == "edge" else (edges, table)
    return edges, nodes
