"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

The lexicon is learnt: words and word beginnings that are far commoner in
documents labelled toxic. Lexicon, trees and calibration are fitted on at most
``FIT_ROWS`` labelled training rows, drawn by a hash of their ids; the calibration
uses a quarter of them that the trees have not seen; every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.llm.columns import put_back, set_aside
from tgraph.session import materialize

FIT_ROWS = 30_000  # bound of the labelled sample for lexicon, trees and calibration
CALIBRATION = 0.25  # its share for the calibration
CANDIDATES = 50_000  # terms of toxic rows whose other occurrences are counted
TERMS = 5_000  # terms kept, by weight and support
LEAST_WEIGHT = 1.5  # log odds of a term
THRESHOLD = 0.3

# What ``dense`` returns, in this order.
FEATURES = (
    "hit_rate weight_rate max_weight top_weights log_hits log_terms second_near second_rate capitals "
    "all_caps marks punctuation obfuscated digits log_words"
).split()

# Second-person words of the languages at hand, and letters behind common substitutes.
SECOND = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen ihr euch euer tu te toi ton tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
_STRIP = ".,;:!?\"'()[]{}<>…«»“”‘’-"
_REPEATED = re.compile(r"(.)\1{2,}")
_JOINERS = re.compile(r"[^\w]|_")


def spellings(token: str) -> list[str]:
    """A token's plain form, and forms without substitutes, joiners and repeats."""
    out = [token]
    if not token.isalpha():
        plain = _JOINERS.sub("", token.translate(SUBSTITUTES))
        if plain.isalpha():
            out.append(plain)
    out.extend([r for t in out if (r := _REPEATED.sub(r"\1", t)) != t])
    return out


def terms(token: str) -> list[str]:
    """What the lexicon may hold of a token: its spellings and their beginnings."""
    out = []
    for t in spellings(token):
        out.append(t)
        if len(t) > 4:
            out.append(t[:4] + "-")
        if len(t) > 5:
            out.append(t[:5] + "-")
    return out


def tokens(text: str | None) -> list[str]:
    return [t.strip(_STRIP) for t in (text or "").lower().split()]


def _count_terms(wanted: frozenset | None):
    """Per batch: in how many texts each term occurs, of those wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0):
                own = {x for t in set(tokens(text.as_py())) for x in terms(t)}
                found.update(own if wanted is None else own & wanted)
            found.pop("", None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["term", "n"]
            )

    return run


def learn_lexicon(labelled: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """Weights (log odds) of terms, from rows (text, toxic); at most ``TERMS``.
    ``sizes`` has the number of rows of either label."""
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}

    def counted(toxic: int, wanted: frozenset | None) -> DataFrame:
        rows = labelled.where(F.col("toxic") == toxic).select("text")
        return rows.mapInArrow(_count_terms(wanted), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))

    common = counted(1, None).where(F.col("n") >= max(3, n_toxic // 2000))
    common = {r.term: r.n for r in common.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    clean = {r.term: r.n for r in counted(0, frozenset(common)).collect()}
    weight = {t: np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in common.items()}
    kept = sorted((t for t, w in weight.items() if w >= LEAST_WEIGHT), key=lambda t: (-weight[t] * np.log1p(common[t]), t))
    return {t: float(weight[t]) for t in kept[:TERMS]}


def dense(text: str | None, known: dict[str, float], weight) -> list[float]:
    """The features of one text; ``known`` remembers the weights of tokens."""
    words = tokens(text)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n, chars = max(len(words), 1), max(len(raw), 1)
    for t in set(words).difference(known):
        known[t] = weight(t)
    hits = [(i, w) for i, w in enumerate(map(known.__getitem__, words)) if w > 0]
    second = [i for i, t in enumerate(words) if t in SECOND]
    weights = sorted((w for _, w in hits), reverse=True)
    near = 0
    if hits and second:
        at, places = np.array(second), np.array([i for i, _ in hits])
        right = np.searchsorted(at, places)
        gap = np.minimum(
            np.abs(at[np.minimum(right, len(at) - 1)] - places), np.abs(places - at[np.maximum(right - 1, 0)])
        )
        near = float((gap <= 5).sum())
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    odd = sum(1 for t in set(words) if t and not t.isalpha() and len(t) > 2 and spellings(t)[-1].isalpha())
    caps = sum(1 for t in set((text or "").split()) if len(t) > 2 and t.isupper())
    letters = max(int(upper.sum()) + int(lower.sum()), 1)
    mark = (raw == 33) | (raw == 63)
    punct = ((raw > 32) & (raw < 48)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 127))
    return [
        len(hits) / n, sum(weights) / n, weights[0] if weights else 0.0, sum(weights[:3]), float(np.log1p(len(hits))),
        float(np.log1p(len({words[i] for i, _ in hits}))), near / max(len(hits), 1), len(second) / n, int(upper.sum()) / letters,
        caps / n, int(mark.sum()) / n, int(punct.sum()) / chars, odd / n, int(((raw >= 48) & (raw <= 57)).sum()) / chars, float(np.log1p(len(words))),
    ]


def features(text: Column, lexicon: dict[str, float]) -> Column:
    """The dense features of a text column, as an array."""

    def weight(token: str) -> float:
        return max((lexicon.get(t, 0.0) for t in terms(token)), default=0.0)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for batch in batches:
            rows = []
            for t in batch:
                rows.append(dense(t.as_py(), known, weight))
                if len(known) > 100_000:
                    known.clear()
            yield pa.array(rows, pa.list_(pa.float64()))

    # marked so that the optimizer does not evaluate it once for each use
    return run.asNondeterministic()(text)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with struct ``_toxicity`` (held_out, score, predicted).

    ``score`` is the calibrated probability of the label 1, ``predicted`` is 1
    from ``threshold`` on. Labels are learnt from rows that are not held out;
    null labels and labels without a document are ignored, and of several labels
    of a document the largest counts. A null, empty or wordless text is scored
    like any other, by features of zero. Repeated rows are scored each; a null
    doc_id is scored and never learnt from. If no training row, or only one
    class, is labelled, every score is the smoothed share of toxic labels. Other
    columns pass, but for one called ``_toxicity``, which is replaced; an empty
    table stays empty.
    """
    # not at the top: executors import this module for its functions alone
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    label_id = id_col
    docs, away = set_aside(docs.drop("_toxicity"), ("_features", "_raw", "_raw1", "_p", "_class", "_level", "_score"))
    id_col, text_col = away.get(id_col, id_col), away.get(text_col, text_col)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(label_id).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = lambda seed: F.xxhash64(F.col("doc_id"), F.lit(seed))
    # at most FIT_ROWS short rows, so their documents are found without moving any text
    chosen = materialize(known.orderBy(draw(1), "doc_id").limit(FIT_ROWS), "chosen")
    sample = materialize(own.join(F.broadcast(chosen), "doc_id"), "sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    total = sum(sizes.values())
    checks = F.pmod(draw(2), F.lit(100)) < int(100 * CALIBRATION)
    lexicon = learn_lexicon(sample.select("text", "toxic"), sizes)
    dense_rows = sample.select("doc_id", "toxic", features(F.col("text"), lexicon).alias("dense"))
    dense_rows = materialize(dense_rows, "dense").withColumn("features", array_to_vector("dense"))
    fit, check = dense_rows.where(~checks), dense_rows.where(checks)
    if any(part.select("toxic").distinct().count() < 2 for part in (fit, check)):
        scored = docs.withColumn("_score", F.lit((sizes.get(1, 0) + 1) / (total + 2)))
    else:
        raw = vector_to_array("_p")[1]
        boost = GBTClassifier(labelCol="toxic", featuresCol="features", predictionCol="_class", maxIter=20, maxDepth=4, stepSize=0.3, maxBins=64, seed=7)
        trees = boost.setRawPredictionCol("_raw").setProbabilityCol("_p").fit(fit)
        rising = IsotonicRegression(labelCol="toxic", featuresCol="_raw1", predictionCol="_level").fit(trees.transform(check).withColumn("_raw1", raw))
        held = docs.withColumn("_features", array_to_vector(features(F.col(text_col).cast("string"), lexicon)))
        scored = trees.setFeaturesCol("_features").transform(held).withColumn("_raw1", raw)
        # a little of the uncalibrated probability orders what one step of the calibration holds
        scored = rising.transform(scored).withColumn("_score", 0.99 * F.col("_level") + 0.01 * F.col("_raw1"))
    verdict = F.struct(held_out(id_col).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
    return put_back(scored.select(*docs.columns, verdict.alias("_toxicity")), away)
