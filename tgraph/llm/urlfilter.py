"""URL filters: rules first, then a ratio of character language models, in DataFrame functions only.

The URLs that rules allow and block train two Markov models of variable order:
the probability of a character after the four before it, smoothed by Witten and
Bell's method with that after the three before it, and so on down to no context.
A URL that no rule fits is judged by the mean log ratio of its characters, with
a threshold calibrated on a held-out quarter of the URLs that rules judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tgraph.session import materialize

ORDER = 4  # characters of context at most
ALPHABET = 256  # characters that share the rest of the probability evenly
BROADCAST_ROWS = 500_000  # n-grams, of ORDER + 1 characters and a number each

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host: after the first ``://`` up to /, ?, # or the end; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path: after the host up to ?, # or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def text_of(url: Column) -> Column:
    """What the models read: the host, then all that follows it, query string and fragment too; without ``://`` the whole url."""
    host = host_of(url)
    after = F.substring(_rest(url), F.length(host) + 1, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.concat(host, after)).otherwise(url), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    A rule is a host and the begin of a path; it fits the host and its subdomains.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column) -> Column:
    """Each character of the text, and its end, after the ``ORDER`` before it."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio): log P(accepted) - log P(rejected) of each wanted gram's last character.

    ``counts`` has (gram, a, r): how often each gram is in accepted and rejected
    URLs. Counts of shorter contexts are sums of these.
    """
    out = wanted.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pr", F.lit(1.0 / ALPHABET))
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        own = counts.groupBy(tail.alias("tail")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        kinds = lambda c: F.sum((F.col(c) > 0).cast("int"))
        context = own.groupBy(F.substring("tail", 1, k).alias("context")).agg(
            F.sum("na").alias("ca"), kinds("na").alias("ta"), F.sum("nr").alias("cr"), kinds("nr").alias("tr")
        )
        out = out.withColumn("tail", tail).join(own, "tail", "left").withColumn("context", F.substring("tail", 1, k)).join(context, "context", "left")

        def smooth(p: str, n: str, total: str, kinds: str) -> Column:
            seen = F.coalesce(total, F.lit(0)) > 0
            return F.when(seen, (F.coalesce(n, F.lit(0)) + F.col(kinds) * F.col(p)) / (F.col(total) + F.col(kinds))).otherwise(F.col(p))

        out = out.select("gram", smooth("pa", "na", "ca", "ta").alias("pa"), smooth("pr", "nr", "cr", "tr").alias("pr"))
    return out.select("gram", (F.ln("pa") - F.ln("pr")).alias("ratio"))


def threshold(scores: DataFrame) -> float:
    """The score, of (score, accepted), from which on the mean of both classes' hit rates is best.

    It lies halfway between the best cut and the next score below. Scores are
    whole thousandths, so the table of cuts is small whatever the number of rows.
    Of equal cuts the least is taken; 0 if a class is missing.
    """
    by = scores.groupBy("score").agg(F.sum(F.col("accepted").cast("int")).alias("a"), F.sum((~F.col("accepted")).cast("int")).alias("r"))
    total = by.agg(F.sum("a"), F.sum("r")).first()
    if not total[0] or not total[1]:
        return 0.0
    # one small row per thousandth, so one task may run over them in order
    order = Window.orderBy("score")
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    lost, out = (F.coalesce(F.sum(c).over(lower), F.lit(0)) for c in ("a", "r"))
    below = F.coalesce(F.lag("score").over(order), F.col("score"))
    rate = F.round((1 - lost / total[0]) + out / total[1], 9)
    cuts = by.select(((F.col("score") + below) / 2).alias("cut"), rate.alias("rate"), "score")
    return cuts.orderBy(F.desc("rate"), "score").first()[0]


def calibration(text: Column) -> Column:
    """Whether a judged URL calibrates; the other three quarters train the models."""
    return F.substring(F.md5(text), 1, 1).isin("0", "1", "2", "3")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (page_id, host, path, rule, verdict, score) per page.

    ``rule`` is the longest that fits, else null; ``verdict`` is the rule's, or
    what the models say: allow if the score reaches the threshold, else block.
    ``score``, a whole number of thousandths, is the mean log ratio; null where a
    rule decides. The rules see host and path; the models read the whole url after
    ``://``, query string and fragment included, or all of it without ``://``. A
    null or empty url, or one without ``://``, has an empty host and path and is
    judged like any other. If rules allow no URL or block none,
    the others are allowed, as there is nothing to compare. Repeated rows are
    judged each and teach each; other columns are ignored; an empty table gives
    an empty result.
    """
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), text_of(url).alias("text"))
    own = own.withColumn("told", rule_of(F.col("host"), F.col("path"), rules))
    own = materialize(own, "urls")
    accepted = F.col("told.verdict") == "allow"
    # distinct texts are scored once, whatever the number of their pages
    texts = own.groupBy("text").agg(
        F.sum(F.when(accepted, 1).otherwise(0)).alias("a"), F.sum(F.when(~accepted, 1).otherwise(0)).alias("r"), F.max(F.col("told").isNull()).alias("open")
    )
    texts = materialize(texts.select("text", "a", "r", "open", calibration(F.col("text")).alias("checks")), "texts")
    train = texts.where("not checks and a + r > 0").select("a", "r", F.explode(grams(F.col("text"))).alias("gram"))
    counts = materialize(train.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "counts")
    row = counts.agg(F.max("a"), F.max("r")).first()
    result = ["page_id", "host", "path", F.col("told.rule").alias("rule")]
    if not row[0] or not row[1]:
        verdict = F.coalesce("told.verdict", F.lit("allow"))
        return own.select(*result, verdict.alias("verdict"), F.lit(None).cast("bigint").alias("score"))
    asked = texts.where("open or checks").select("text", F.explode(grams(F.col("text"))).alias("gram"))
    ratios = materialize(log_ratios(counts, asked.select("gram").distinct()), "ratios")
    ratios = F.broadcast(ratios) if ratios.count() <= BROADCAST_ROWS else ratios
    score = F.round(F.avg("ratio") * 1000).cast("bigint")
    scored = materialize(asked.join(ratios, "gram").groupBy("text").agg(score.alias("score")), "scored")
    checks = scored.join(texts.where("checks and a + r > 0"), "text")
    cut = threshold(checks.select("score", (F.col("a") >= F.col("r")).alias("accepted")))
    said = F.when(F.col("score") >= cut, "allow").otherwise("block")
    out = own.join(scored, "text", "left")
    score = F.when(F.col("told").isNull(), F.col("score"))
    return out.select(*result, F.coalesce("told.verdict", said).alias("verdict"), score.alias("score"))
