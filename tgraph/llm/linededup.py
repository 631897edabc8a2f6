"""Boilerplate lines by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.llm.columns import put_back, set_aside
from tgraph.session import materialize

RATIO = 0.01  # of a host's pages
LEAST_PAGES = 5  # that a line must be on
MOST_DROPPED = 0.5  # of a page's characters

_KEY = "xxhash64(trim(BOTH ' \\t\\r' FROM line))"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def frequent_lines(docs: DataFrame, host_col: str, text_col: str, ratio: float, least_pages: int) -> DataFrame:
    """Rows (host, boilerplate): hashes of lines on more than ``ratio`` of a host's
    different pages. A host has fewer than (lines of a mean page) / ratio of them."""
    page = docs.select(F.col(host_col).alias("host"), F.xxhash64(text_col).alias("page"), lines(F.col(text_col)).alias("lines"))
    page = page.where("lines is not null")
    total = page.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    full = "filter(lines, line -> trim(BOTH ' \\t\\r' FROM line) <> '')"
    # copies of a page, and repeats within it, fall together before the count
    each = page.select("host", "page", F.explode(F.array_distinct(F.expr(f"transform({full}, line -> {_KEY})"))).alias("line")).distinct()
    counted = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    common = counted.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    common = common.where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("c.host").agg(F.sort_array(F.collect_list("line")).alias("boilerplate"))


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    most_dropped: float = MOST_DROPPED,
) -> DataFrame:
    """``docs`` with the cleaned text, and struct ``_lines`` (total, dropped, frequent).

    A line, without spaces, tabs and returns at its ends, is boilerplate if it is
    on more than ``ratio`` of its host's pages and on ``least_pages`` or more.
    Pages of equal text count once, so that mass copies do not make a line
    frequent. Its occurrences are dropped, but for pages on which such lines have
    more than ``most_dropped`` of the characters: those are copies as a whole and
    are left to the near-duplicate stage. ``frequent`` counts such lines on the page,
    dropped or not. Blank lines are neither counted nor dropped. A null text stays
    null, an empty one empty, both without lines to drop; a null host is a host of
    its own. Rows that repeat are cleaned each; other columns pass unchanged, but
    for one called ``_lines``, which is replaced. Lines are joined by newlines again.
    """
    docs, away = set_aside(docs, ("_host", "boilerplate", "_all", "_rest"))
    host_col, text_col = away.get(host_col, host_col), away.get(text_col, text_col)
    common = materialize(frequent_lines(docs, host_col, text_col, ratio, least_pages), "boilerplate").withColumnRenamed("host", "_host")
    out = docs.drop("_lines").join(common, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    out = out.withColumn("_all", lines(F.col(text_col)))
    hit = f"boilerplate is not null and array_contains(boilerplate, {_KEY})"
    out = out.withColumn("_rest", F.expr(f"filter(_all, line -> not ({hit}))"))
    share = F.length(F.array_join("_all", "")) * F.lit(1 - most_dropped)
    keep = F.length(F.array_join("_rest", "")) >= share
    frequent = F.coalesce(F.size("_all") - F.size("_rest"), F.lit(0))
    report = F.struct(
        F.coalesce(F.size("_all"), F.lit(0)).cast("bigint").alias("total"),
        F.when(keep, frequent).otherwise(0).cast("bigint").alias("dropped"),
        frequent.cast("bigint").alias("frequent"),
    )
    text = F.when(keep & (frequent > 0), F.array_join("_rest", "\n")).otherwise(F.col(text_col))
    out = out.withColumn("_lines", report).withColumn(text_col, text)
    return put_back(out.drop("_host", "boilerplate", "_all", "_rest"), away)
