"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tgraph.llm.columns import put_back, set_aside
from tgraph.session import materialize

SHARE = 0.7  # of the tokens to be kept
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.7}  # targets: tokens to this power, scaled to 1
TOLERANCE = 1e-9
SWEEPS = 200

# Marks in a text, the first of which names its topic.
TOPICS = (
    ("legal", ("license", "License", "Copyright", "copyright")),
    ("contact", ("@",)),
    ("technical", ("http", "token", "password", "= \"")),
    ("tabular", (" | ",)),
)


def topic_of(text: Column) -> Column:
    """The first topic of ``TOPICS`` that has a mark in the text, else ``prose``."""
    out = F.lit("prose")
    for name, marks in reversed(TOPICS):
        has = reduce(lambda a, b: a | b, (F.coalesce(F.contains(text, F.lit(m)), F.lit(False)) for m in marks))
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Number of words between blanks; null and blank texts have none."""
    trimmed = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\r", "   "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " +"))).cast("bigint")


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def _largest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def rake(cells: DataFrame, exponents: dict[str, float], targets: dict[str, dict] | None = None) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: shares of the mix.

    Each sweep scales the weights to one marginal after the other. The sweeps end
    when none changes a weight by more than ``TOLERANCE``, relatively, or a sweep
    changes as much as the one before, or after ``SWEEPS``: marginals that contradict
    each other cannot all be met, and the last dimension then is. A target is the share named in
    ``targets``, or else the tokens to the power of the dimension's exponent, scaled
    to what the named ones leave. A dimension's marginals are summed by partial
    aggregation; no dimension is gathered in one task.
    """
    margins = {}
    for dim, power in exponents.items():
        own = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("raw", F.pow(F.col("t"), F.lit(power)))
        named = (targets or {}).get(dim, {})
        given = F.lit(None).cast("double")
        for value, share in named.items():
            given = F.when(F.col(dim) == value, F.lit(float(share))).otherwise(given)
        own = own.withColumn("given", given)
        rest = own.agg(F.sum(F.when(F.col("given").isNull(), F.col("raw"))).alias("raw"), F.sum("given").alias("given")).first()
        left = max(0.0, 1 - (rest["given"] or 0.0)) / (rest["raw"] or 1.0)
        scale = F.lit(1.0 if rest["raw"] else 1 / (rest["given"] or 1.0))
        margins[dim] = materialize(own.select(dim, (F.coalesce("given", F.col("raw") * left) * scale).alias("target")), "target")
    state = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    before = None
    for _ in range(SWEEPS):
        for dim in exponents:
            now = state.groupBy(dim).agg(F.sum("weight").alias("now"))
            factor = now.alias("n").join(margins[dim].alias("m"), _same("n", "m", [dim]))
            factor = factor.select(F.col(f"n.{dim}").alias(dim), (F.col("target") / F.col("now")).alias("factor"))
            state = state.alias("s").join(factor.alias("f"), _same("s", "f", [dim])).select(
                *(F.col(f"s.{c}") for c in state.columns if c not in ("weight", f"_f_{dim}")),
                (F.col("s.weight") * F.col("factor")).alias("weight"), F.col("factor").alias(f"_f_{dim}"),
            )
            # written at once: a state is read twice, so plans would double with every step
            state = materialize(state, "raked")
        off = state.agg(F.max(_largest([F.abs(F.col(f"_f_{d}") - 1) for d in exponents]))).first()[0] or 0.0
        if off <= TOLERANCE or (before is not None and off >= before):
            break
        before = off
    state = state.drop(*(f"_f_{d}" for d in exponents))
    return state


def rates(raked: DataFrame, share: float) -> DataFrame:
    """``raked`` with ``probability`` = min(1, scale * weight / tokens), the scale
    such that ``share`` of all tokens is expected to be kept.

    Cells that reach 1 hold no more tokens; the others' scale is raised until the
    set of full cells stays the same.
    """
    rate = F.col("weight") / F.col("tokens")
    total = raked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    goal, scale, full_before = share * total, 0.0, -1
    while total:
        full = rate * scale >= 1
        free = F.when(~full, F.col("weight")).otherwise(0.0)
        row = raked.agg(F.sum(full.cast("int")).alias("n"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("held"), F.sum(free).alias("free")).first()
        if row["n"] == full_before or not row["free"]:
            break
        full_before, scale = row["n"], max(scale, (goal - row["held"]) / row["free"])
    return raked.withColumn("probability", F.least(F.lit(1.0), rate * scale))


def draw(key: Column, seed: str = "mix") -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, share: float = SHARE, exponents: dict[str, float] | None = None, targets: dict[str, dict] | None = None,
    topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with struct ``_mix`` (topic, tokens, probability, kept).

    The dimensions are columns of ``docs``, but for ``topic``, which is
    computed (``topic_of`` by default). The tokens of each combination that occurs
    are raked to the targets; every document of a combination is kept with the
    same probability, drawn from a hash of its id (of its text if the id is null),
    so that repeated rows share their fate and reruns agree. Nulls are values of
    their own. Documents without tokens weigh nothing: they get the probability of
    their combination, or ``share`` if that has no tokens at all. Other columns
    pass, but for one called ``_mix``, which is replaced; an empty table stays empty.
    """
    exponents = exponents or EXPONENTS
    dims = list(exponents)
    docs, away = set_aside(docs, ("_p", *(f"_c_{d}" for d in dims)))
    id_col, text_col = away.get(id_col, id_col), away.get(text_col, text_col)
    own = docs.drop("_mix").withColumn("_mix", F.struct((topic_of(F.col(text_col)) if topic is None else topic).alias("topic"), tokens_of(F.col(text_col)).alias("tokens")))
    at = {d: F.col("_mix.topic") if d == "topic" else F.col(d) for d in dims}
    cells = materialize(own.groupBy(*(c.alias(d) for d, c in at.items())).agg(F.sum("_mix.tokens").alias("tokens")), "cells")
    rated = materialize(rates(rake(cells, exponents, targets), share).select(*(F.col(d).alias(f"_c_{d}") for d in dims), F.col("probability").alias("_p")), "rates")
    match = reduce(lambda x, y: x & y, (c.eqNullSafe(F.col(f"_c_{d}")) for d, c in at.items()))
    out = own.join(rated, match, "left")
    p = F.coalesce("_p", F.lit(share))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("_mix", F.struct("_mix.topic", "_mix.tokens", p.alias("probability"), (draw(key) < p).alias("kept")))
    return put_back(out.drop("_p", *(f"_c_{d}" for d in dims)), away)
