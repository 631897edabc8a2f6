"""Language identification: scripts narrow the candidates, Viterbi labels spans.

A word is a run of letters of one script. Its score for a language is the sum of
the log probabilities of its letters, pairs and threes of letters, and ending, counted over every training
text. Only languages that use the word's script are candidates. Viterbi's
algorithm over the words, with a penalty for each switch, gives spans; the
language with most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tgraph.llm.textnum import slices

BUCKETS = 1 << 16  # hashed n-grams of a language
LANGUAGES = 256  # a model of more is refused: it is broadcast, of LANGUAGES * BUCKETS numbers at most
LEAST_SHARE = 0.005  # of a language's letters, for a script to be one of its own
SWITCH = 6.0  # log cost of changing the language between two words
PIECE = 1 << 20  # characters scored at once
CELLS = 1 << 24  # characters times languages labelled together
UNKNOWN = "und"

# First and last code point of the blocks of each script. Letters elsewhere are "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER = len(SCRIPTS) + 1


@cache
def script_table() -> np.ndarray:
    """Script number of each code point; 0 is no letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table = np.full(0x110000, OTHER, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            table[lo : hi + 1] = number
    return np.where(letter, table, 0).astype(np.uint8)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Letters:
    """The letters of a piece of text: their places, codes and scripts, and which follow on the one before."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        script = script_table()[code]
        self.at = np.flatnonzero(script)
        self.code, self.script = code[self.at].astype(np.uint64) + np.uint64(1), script[self.at]
        self.joined = np.zeros(len(self.at), bool)
        self.joined[1:] = (np.diff(self.at) == 1) & (self.script[1:] == self.script[:-1])

    def buckets(self) -> Iterator[np.ndarray]:
        """For each kind of n-gram, the bucket of the one that ends at each letter; ``BUCKETS`` is none.

        Kinds are single letters, two and three of them, where a blank may stand
        before the word, and the last three of a word.
        """
        total, inside = self.code, np.ones(len(self.code), bool)
        yield _bucket(total + np.uint64(1))
        for n in (2, 3):
            reach = inside  # the last n - 1 letters are of the word
            inside = inside & _shift(self.joined, n - 2, False)
            total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, _shift(self.code, n - 1, np.uint64(1)), np.uint64(1))
            bucket = _bucket(total + np.uint64(n))
            yield bucket if n == 2 else np.where(reach, bucket, BUCKETS)
        last = np.concatenate((~self.joined[1:], [True])) if len(self.joined) else self.joined
        yield np.where(last, _bucket(total + np.uint64(99)), BUCKETS)


def _shift(x: np.ndarray, n: int, fill) -> np.ndarray:
    return x if n == 0 else np.concatenate((np.full(min(n, len(x)), fill, x.dtype), x[: max(len(x) - n, 0)]))


def _bucket(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(48)).astype(np.int64)


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """A text in parts of bounded length, cut where no word is if there is such a place near."""
    start = 0
    while start < len(text):
        end = min(start + PIECE, len(text))
        if end < len(text):
            end = next((e for e in range(end, max(end - 1000, start), -1) if not text[e - 1].isalpha()), end)
        yield start, text[start:end]
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n); buckets below 0 count the letters of a script."""
    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            own = np.zeros(BUCKETS + 1, np.int64)
            scripts = np.zeros(OTHER + 1, np.int64)
            for _, _, texts in slices(batch.column(1).filter(pc.equal(langs, lang)), PIECE):
                for _, piece in _pieces("\n".join(_lower(t or "") for t in texts)):
                    letters = Letters(piece)
                    scripts += np.bincount(letters.script, minlength=OTHER + 1)
                    for bucket in letters.buckets():
                        own += np.bincount(bucket, minlength=BUCKETS + 1)
            own = np.concatenate((own[:BUCKETS], scripts))
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < BUCKETS, at, BUCKETS - 1 - at)), pa.array(own[at])],
                ["lang", "bucket", "n"],
            )


class Model:
    """Languages in order, log probabilities (bucket, language), scripts (script, language)."""

    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        self.langs = langs
        smooth = counts.astype(np.float64) + 0.5
        # the last row is that of no bucket
        self.log_p = np.concatenate((np.log(smooth / smooth.sum(0)), np.zeros((1, len(langs))))).astype(np.float32)
        share = letters / np.maximum(letters.sum(0), 1)
        self.uses = share >= LEAST_SHARE
        self.prior = letters.sum(0)


def learn(rows: DataFrame) -> Model:
    """A model from all rows (lang, text). It holds one number for each bucket
    and language, whatever the number of rows."""
    counted = rows.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r.lang for r in rows.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = counted.toPandas()
    at = {lang: i for i, lang in enumerate(langs)}
    counts, letters = np.zeros((BUCKETS, len(langs))), np.zeros((OTHER + 1, len(langs)))
    column, bucket, n = table["lang"].map(at).to_numpy(int), table["bucket"].to_numpy(int), table["n"].to_numpy(float)
    gram = bucket >= 0
    counts[bucket[gram], column[gram]] = n[gram]
    letters[-1 - bucket[~gram], column[~gram]] = n[~gram]
    letters[0] = 0
    return Model(langs, counts, letters)


def word_scores(text: str, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and scores (word, language) of the words of a lower-cased text."""
    starts, ends, scores = [], [], []
    for offset, piece in _pieces(text) if model.langs else ():
        letters = Letters(piece)
        if not len(letters.at):
            continue
        first = np.flatnonzero(~letters.joined)
        total = np.zeros((len(letters.at), len(model.langs)), np.float32)
        for bucket in letters.buckets():
            total += model.log_p[bucket]
        own = np.add.reduceat(total, first)
        uses = model.uses[letters.script[first]]
        # a script that no language uses tells nothing; one that some use rules out the others
        none = ~uses.any(1)
        own = np.where(uses, own, own.min(1, keepdims=True) - np.float32(1e3))
        own[none] = 0
        starts.append(letters.at[first] + offset)
        ends.append(letters.at[np.concatenate((first[1:], [len(letters.at)])) - 1] + 1 + offset)
        scores.append(own - own.max(1, keepdims=True))
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty((0, len(model.langs)), np.float32)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(scores)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best labels of each sequence; all sequences go forward together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = order[: int((lengths > 0).sum())]
    lengths = lengths[: len(order)]
    if not len(order):
        return out
    n_lang = scores[0].shape[1]
    first = np.cumsum(lengths) - lengths
    flat = np.concatenate([scores[i] for i in order]).astype(np.float64)
    switched = np.zeros(len(flat), np.uint16)  # the label before, if the language changes here
    stays = np.ones((len(flat), n_lang), bool)
    best = flat[first]
    active = len(order)
    finals = np.zeros((len(order), n_lang))
    for t in range(1, int(lengths[0])):
        now = int(np.searchsorted(-lengths, -t, "left"))  # sequences longer than t
        finals[now:active] = best[now:active]
        best, active = best[:now], now
        at = first[:now] + t
        top = best.argmax(1)
        change = best[np.arange(now), top][:, None] - penalty
        stay = best >= change
        switched[at], stays[at] = top, stay
        best = np.where(stay, best, change) + flat[at]
        best -= best.max(1, keepdims=True)
    finals[:active] = best
    labels = np.zeros(len(flat), np.int64)
    current = finals.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        now = int(np.searchsorted(-lengths, -t, "left"))
        at = first[:now] + t
        labels[at] = current[:now]
        current[:now] = np.where(stays[at, current[:now]], current[:now], switched[at])
    for j, i in enumerate(order):
        out[i] = labels[first[j] : first[j] + lengths[j]]
    return out


def _label(model: Model, penalty: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = int(model.prior.argmax()) if len(model.langs) else 0
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1), max(PIECE // 16, CELLS // max(len(model.langs), 1))):
                lowered = [_lower(t or "") for t in texts]
                start, end, own = word_scores("\n".join(lowered), model)
                begin = np.cumsum([0] + [len(t) + 1 for t in lowered])
                cuts = np.searchsorted(start, begin)
                parts = [(start[x:y] - b, end[x:y] - b, own[x:y]) for x, y, b in zip(cuts, cuts[1:], begin)]
                langs, scores, found = [], [], []
                for (start, end, own), labels in zip(parts, viterbi([p[2] for p in parts], penalty)):
                    if not len(start) or not model.langs:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        found.append([])
                        continue
                    share = np.bincount(labels, (end - start).astype(float), len(model.langs))
                    share /= share.sum()
                    told = own.any()
                    top = int(share.argmax()) if told else prior
                    langs.append(model.langs[top])
                    scores.append(float(share[top]) if told else 0.0)
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1))
                    last = np.concatenate((cut[1:], [len(labels)])) - 1
                    found.append([{"start": int(start[a]), "end": int(end[z]), "lang": model.langs[labels[a]]} for a, z in zip(cut, last)] if spans else [])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                names = ["doc_id", "lang_pred", "score"]
                if spans:
                    columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH, spans: bool = True
) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score[, spans]) per document.

    Learns from the text and language of rows that are not held out and whose
    language is not null. ``score`` is the share of the text's letters in spans
    of ``lang_pred``. ``spans`` lists (start, end, lang) in characters. A text
    that is null, empty or without a letter gets ``und``, score 0 and no spans;
    one whose only letters are of scripts that no learnt language uses gets the
    language with most letters learnt and score 0; without any training row all
    is ``und``. Equal sums go to the language that sorts first. Repeated rows are
    labelled each, and a null doc_id never teaches. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    train = own.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    model = learn(train.select("lang", "text"))
    schema = "doc_id bigint, lang_pred string, score double"
    schema += ", spans array<struct<start: bigint, end: bigint, lang: string>>" if spans else ""
    out = own.select("doc_id", "text").mapInArrow(_label(model, penalty, spans), schema)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", *(["spans"] if spans else []))
