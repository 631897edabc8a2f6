"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts: lists of messages, instruction and output, prompt
and completion, one row per turn. A record's nested field paths, as far as any
mapping knows them, are hashed to a fingerprint; the fingerprint selects a
declarative mapping, which says where the turns' roles and texts are. Records
that no mapping knows are listed by ``rejected``, with a hash of all their paths.

The template is ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE`` per turn. A
backslash escapes: itself, the bar of ``<|`` in texts and roles, and a newline in
roles. So no control string can come from a text, and unescaping is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CHUNK = 64  # turns put together before a conversation is


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    ``paths`` are the field paths that make the layout. With ``items``, the path
    of a list, ``turns`` has one (role field, text field) for its elements;
    without, it has a (role, path) pair for every turn of the record, in order. A
    role that begins with ``$`` is itself a path. ``optional`` fields may miss.
    ``renamed`` roles are those of ``ROLES``; others are taken as they are.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    items: str = ""
    optional: tuple[str, ...] = ()
    renamed: bool = False


MAPPINGS = (
    Mapping("messages", ("$.messages",), (("$.role", "$.content"),), "$.messages", ("$.messages[0].role", "$.messages[0].content")),
    Mapping("sharegpt", ("$.conversations",), (("$.from", "$.value"),), "$.conversations", ("$.conversations[0].from", "$.conversations[0].value"), renamed=True),
    Mapping("turn", ("$.role",), (("$.role", "$.text"),), "", ("$.text",)),
    Mapping("turn_content", ("$.role", "$.content"), (("$.role", "$.content"),)),
    Mapping("turn_text_first", ("$.role", "$.content", "$.text"), (("$.role", "$.text"),)),
    Mapping("turn_no_role", ("$.text",), (("$.role", "$.text"),)),
    Mapping("alpaca", ("$.instruction", "$.output"), (("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")), "", ("$.system", "$.input")),
    Mapping("prompt_completion", ("$.prompt", "$.completion"), (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion")), "", ("$.system",)),
    Mapping("prompt_response", ("$.prompt", "$.response"), (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")), "", ("$.system",)),
    Mapping("question_answer", ("$.question", "$.answer"), (("user", "$.question"), ("assistant", "$.answer"))),
)

# Role names of other layouts and what they are called here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURN = "array<struct<role: string, text: string>>"


def _known(mappings: tuple[Mapping, ...]) -> list[str]:
    return sorted({p for m in mappings for p in (*m.paths, *m.optional)})


def fingerprint(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Hash of the sorted field paths of a variant that some mapping knows."""
    present = [F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in _known(mappings)]
    return F.xxhash64(F.concat_ws("|", *present))


def _layouts(mapping: Mapping) -> list[list[str]]:
    """The sets of paths that a record of the mapping may have."""
    out = [[]]
    for p in mapping.optional:
        out += [[*x, p] for x in out]
    return [sorted((*mapping.paths, *x)) for x in out]


def _role(role: Column, renamed: bool) -> Column:
    named = role
    for other, own in ROLES.items() if renamed else ():
        named = F.when(F.lower(F.trim(role)) == other, F.lit(own)).otherwise(named)
    return F.coalesce(named, F.lit(""))


def _turns(record: Column, mapping: Mapping) -> Column:
    def one(of: Column, role: str, text: str) -> Column:
        name = _role(F.try_variant_get(of, role, "string"), mapping.renamed) if role.startswith("$") else F.lit(role)
        return F.struct(name.alias("role"), F.coalesce(F.try_variant_get(of, text, "string"), F.lit("")).alias("text"))

    if mapping.items:
        (role, text), *_ = mapping.turns
        return F.transform(F.try_variant_get(record, mapping.items, "array<variant>"), lambda x: one(x, role, text))

    def there(role: str, text: str) -> Column:
        found = F.try_variant_get(record, text, "variant").isNotNull()
        return found | F.try_variant_get(record, role, "variant").isNotNull() if role.startswith("$") else found

    turns = F.array(*(F.when(there(r, t), one(record, r, t)) for r, t in mapping.turns))
    return F.filter(turns, lambda x: x.isNotNull())


def canonical_turns(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The turns of a variant, by the mapping its fingerprint selects; null if none does."""
    own = fingerprint(record, mappings)
    out = F.lit(None).cast(TURN)
    for m in reversed(mappings):
        # the hashes of a mapping's layouts are constants
        hashes = [F.xxhash64(F.lit("|".join(paths))) for paths in _layouts(m)]
        out = F.when(own.isin(*hashes), _turns(record, m)).otherwise(out)
    return out


def paths(record: Column) -> Column:
    """The nested field paths of a variant, without the types of their values, as one text.

    Elements of a list are taken together. ``{"a": [{"b": 1}], "c": "x"}`` gives
    ``OBJECT<a: ARRAY<OBJECT<b: _>>, c: _>``; null gives null.
    """
    value = r"(?<=: |ARRAY<|^)(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\d+\))?(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(record), value, "_")


def rejected(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS
) -> DataFrame:
    """Rows (conv_id, turn, paths, fingerprint) of records that no mapping knows.

    ``fingerprint`` hashes all nested field paths, so that records of one unknown
    layout group together; both are null for a null record. Repeated rows are listed each.
    """
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(record_col).alias("record"))
    own = own.where(canonical_turns(F.col("record"), mappings).isNull()).withColumn("paths", paths(F.col("record")))
    return own.select("conv_id", "turn", "paths", F.when(F.col("paths").isNotNull(), F.xxhash64("paths")).alias("fingerprint"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", record_col: str = "record", unknown: str = "error"
) -> DataFrame:
    """One row (conv_id, formatted, loss_spans) per conversation.

    ``rows`` has one or more records (variants) per conversation, in the order of
    ``turn_col``; equal or null turns are ordered by role and text, nulls first.
    A null or missing text or role is empty, and an empty list of messages has no
    turns; a conversation without any turn is returned with an empty text. Records
    of no known layout raise an error that names their fingerprint; with ``unknown``
    = "reject" they are left to ``rejected``, which lists them. ``loss_spans`` lists (start, size), in characters of
    ``formatted``, of the assistant's escaped texts. A null conv_id is a
    conversation of its own; an empty table gives none. Other columns are ignored.

    Turns are rendered where they are; a conversation is put together in chunks of
    ``CHUNK`` records, so its rows never meet in one task, only its finished text does.
    """
    if unknown not in ("error", "reject"):
        raise ValueError("unknown must be error or reject")
    failed = F.raise_error(F.concat(F.lit("no mapping for records of fingerprint "), fingerprint(F.col("record")).cast("string"))).cast(TURN)
    turns = F.coalesce("turns", failed) if unknown == "error" else F.col("turns")
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(record_col).alias("record"))
    own = own.withColumn("turns", canonical_turns(F.col("record")))
    own = own if unknown == "error" else own.where("turns is not null")
    own = own.select("conv_id", "turn", F.posexplode_outer(turns).alias("at", "said"))
    role = F.replace(escape(F.col("said.role")), F.lit("\n"), F.lit("\\\n"))
    text = escape(F.col("said.text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    own = own.select(
        "conv_id", "turn", "at", "said", F.coalesce(F.concat(head, text, F.lit(END + "\n")), F.lit("")).alias("line"),
        F.when(F.col("said.role") == "assistant", F.struct(F.length(head).cast("bigint").alias("start"), F.length(text).cast("bigint").alias("size"))).alias("span"),
    )
    turn = F.struct("turn", "at", "said", "line", F.length("line").cast("bigint").alias("n"), "span")
    part = F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK)
    chunks = own.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    # null turns sort last in array_sort, but their part is the first
    spans = """aggregate(t, struct(0L as n, cast(array() as array<struct<start: bigint, size: bigint>>) as spans),
        (acc, x) -> struct(acc.n + x.n as n, if(x.span is null, acc.spans,
            concat(acc.spans, array(struct(acc.n + x.span.start as start, x.span.size as size)))) as spans))"""
    chunks = chunks.select("conv_id", "part", F.array_join(F.col("t.line"), "").alias("text"), F.expr(spans).alias("s"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "text", "s"))).alias("c"))
    # offsets of the chunks, then every span moved by its chunk's
    offsets = "aggregate(c, array(0L), (acc, x) -> concat(acc, array(element_at(acc, -1) + x.s.n)))"
    whole = whole.withColumn("o", F.expr(offsets))
    moved = "flatten(transform(c, (x, i) -> transform(x.s.spans, y -> struct(y.start + o[i] as start, y.size as size))))"
    return whole.select("conv_id", F.array_join(F.col("c.text"), "").alias("formatted"), F.expr(moved).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text) from the formatted text and its spans alone."""
    pieces = F.expr(f"filter(split(formatted, '{_pattern(END)}\\n', -1), x -> x <> '')")
    said = F.expr(
        f"""transform(pieces, p -> struct(
            regexp_extract(p, '(?s)^{_pattern(START)}((?:[^\\\\\\\\\\n]|\\\\\\\\.)*)\\n', 1) as role,
            regexp_replace(p, '(?s)^{_pattern(START)}(?:[^\\\\\\\\\\n]|\\\\\\\\.)*\\n', '') as text))"""
    )
    plain = F.transform("said", lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    loss = F.expr("transform(loss_spans, x -> substring(formatted, cast(x.start + 1 as int), cast(x.size as int)))")
    return (
        formatted.withColumn("pieces", pieces).withColumn("said", said)
        .select("conv_id", "formatted", plain.alias("turns"), F.array_join(F.transform(loss, unescape), "").alias("loss_text"))
    )


def _pattern(control: str) -> str:
    return control.replace("|", "[|]")
