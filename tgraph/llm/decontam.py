"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is ten consecutive words of a benchmark item. A document can hold a
window only if it holds all of its words, so the rarest of them, by their
number in all documents, is a sufficient prefix. Documents' words are joined
with these prefix words alone; neighbouring windows mostly share one. Length and
position rule out alignments that stick out of the document, and what is left is
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.llm.columns import put_back, set_aside
from tgraph.session import materialize

WINDOW = 10
BROADCAST_BYTES = 64 << 20  # a benchmark side is broadcast only if it was counted to be smaller

_WORDS_SQL = (
    "array_remove(split(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), '')"
)


def words(text: str) -> Column:
    """Runs of 0-9, A-Z (lower-cased) and non-ASCII characters of a text column; null has none."""
    return F.expr(_WORDS_SQL.format(text=f"cast(`{text}` as string)"))


def _small(df: DataFrame, text: str) -> DataFrame:
    """``df``, marked for broadcast if its counted size allows it."""
    n = df.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def prefixes(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Rows (word, item_id, at, first, last, size, slice): word ``at`` of an item
    is the rarest of its windows ``first`` to ``last``, of ``size`` words each;
    ``slice`` has the words of these windows. ``docs`` and ``items`` have ``words``.

    Windows with a word that no document has are left out.
    """
    at = items.select("item_key", "item_id", F.posexplode("words").alias("at", "word"))
    vocabulary = materialize(at.select("word").distinct(), "vocabulary")
    seen = docs.select(F.explode("words").alias("word")).join(_small(vocabulary, "word"), "word")
    counted = materialize(seen.groupBy("word").agg(F.count("*").alias("n")), "counted")
    # each item's words in order as (n, word, at): the least of a window is its prefix
    known = at.join(counted, "word", "left").groupBy("item_key", "item_id")
    known = known.agg(F.array_sort(F.collect_list(F.struct("at", F.struct("n", "word", "at").alias("w")))).alias("known"))
    placed = known.select("item_key", "item_id", F.col("known.w").alias("placed"), F.col("known.w.word").alias("words"))
    placed = placed.withColumn("size", F.least(F.size("words"), F.lit(window)))
    least = F.expr(
        """transform(sequence(0, size(words) - size), s -> struct(s, if(
            exists(slice(placed, s + 1, size), x -> x.n is null), null, array_min(slice(placed, s + 1, size))) as low))"""
    )
    each = placed.select("item_key", "item_id", "size", "words", F.explode(least).alias("w")).where("w.low is not null")
    groups = each.groupBy("item_key", "item_id", "size", F.col("w.low.at").alias("at"), F.col("w.low.word").alias("word"))
    out = groups.agg(F.min("w.s").alias("first"), F.max("w.s").alias("last"), F.first("words").alias("words"))
    return out.select("word", "item_id", "at", "first", "last", "size", F.expr("slice(words, first + 1, last - first + size)").alias("slice"))


def find(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """One row (doc_key, hits) per document with candidates: the alignments
    (item_id, start, first, last, size, slice), where ``start`` is the place in
    the document of the item's first word."""
    prefix = materialize(prefix.withColumn("prefix_id", F.monotonically_increasing_id()), "prefixes")
    keys = _small(prefix.select("word", "prefix_id", "at", "first", "last", "size"), "word")
    placed = docs.select("doc_key", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    met = placed.join(keys, "word").select("doc_key", "n_words", "prefix_id", "first", "last", "size", start.alias("start"))
    # some window must begin and end inside the document
    fits = (F.col("start") + F.col("last") >= 0) & (F.col("start") + F.col("first") + F.col("size") <= F.col("n_words"))
    # repeated rows of documents give the same alignments
    met = met.where(fits).select("doc_key", "prefix_id", "start").distinct()
    full = prefix.select("prefix_id", "item_id", "first", "last", "size", "slice")
    met = met.join(full, "prefix_id")
    return met.groupBy("doc_key").agg(F.collect_list(F.struct("item_id", "start", "first", "last", "size", "slice")).alias("hits"))


# One expression, so that no part is evaluated once for each use: ``w`` are the
# document's words, ``begins`` of an alignment those of its windows that occur.
_FOUND = """
transform(array({words}), w -> struct(size(w) as n, filter(transform(_hits, h -> struct(h.item_id as item_id, h.size as size, h.start as start, filter(
    sequence(greatest(h.first, -h.start), greatest(h.last, -h.start)),
    s -> s <= h.last and slice(w, h.start + s + 1, h.size) = slice(h.slice, s - h.first + 1, h.size)) as begins)), h -> size(h.begins) > 0) as found))
"""

# Places covered by the sorted [begin, end) pairs of the windows, and the items' ids.
_COUNTED = f"""
transform({_FOUND}, f -> struct(f.n as n,
    coalesce(aggregate(array_sort(flatten(transform(f.found, h -> transform(h.begins, s -> struct(h.start + s as b, h.start + s + h.size as e))))),
        struct(0 as n, 0 as upto),
        (acc, x) -> struct(acc.n + greatest(x.e - greatest(x.b, acc.upto), 0) as n, greatest(x.e, acc.upto) as upto)).n, 0) as hit,
    coalesce(array_sort(array_distinct(transform(f.found, h -> h.item_id))), cast(array() as array<string>)) as ids))
"""

_VERDICT = f"""
transform({_COUNTED}, c -> struct(cast(c.n as bigint) as n_words, cast(c.hit as bigint) as n_hit, cast(size(c.ids) as bigint) as n_items,
    sha2(array_join(c.ids, ','), 256) as items_sha256, c.hit > 0 as contaminated))[0]
"""


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``docs`` with struct ``_contamination`` (n_words, n_hit, n_items, items_sha256, contaminated).

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. ``n_hit`` counts document words inside occurring
    windows, ``n_items`` the items that have some; ``items_sha256`` hashes their
    ids, sorted as strings and joined by commas. A null or wordless text has no
    words and no hits; items that are null, wordless or without an id are ignored;
    an item listed twice counts once, with the windows of all its rows. Repeated
    documents are judged each, a null doc_id too. An empty table of either kind
    gives no hits. Other columns pass, but for one called ``_contamination``, which
    is replaced; whole texts are read.
    """
    item_text = text_col
    docs, away = set_aside(docs.drop("_contamination"), ("_key", "_of", "_hits", "_text"))
    id_col, text_col = away.get(id_col, id_col), away.get(text_col, text_col)
    # rows of equal id and text share a key; alignments are compared with each row's own words
    own = docs.withColumn("_key", F.xxhash64(id_col, text_col))
    held = own.select(F.col("_key").alias("doc_key"), words(text_col).alias("words"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(item_text).alias("words"))
    items = items.where("item_id is not null and size(words) > 0").distinct().withColumn("item_key", F.xxhash64("item_id", "words"))
    hits = find(held, prefixes(held, materialize(items, "items"), window)).select(F.col("doc_key").alias("_of"), F.col("hits").alias("_hits"))
    rows = own.join(hits, F.col("_key") == F.col("_of"), "left").withColumn("_text", F.col(text_col).cast("string"))
    out = rows.select(*docs.columns, F.expr(_VERDICT.format(words=_WORDS_SQL.format(text="_text"))).alias("_contamination"))
    return put_back(out, away)
