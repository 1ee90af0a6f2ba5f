r"""Chat formatting with typed content parts, in DataFrame functions.

A turn's content is a list of parts: text, image, audio or document.  A visitor flattens them in
order: text is escaped; every attachment becomes a placeholder that carries its number within the
turn, its reference is recorded in order, and its expanded token count is added up (an image by
its patches, audio by its seconds, a document by its pages).

Template of a turn, then of a conversation (all turns in order, nothing between them):

    ### <Role>: <text></turn>\n

Control strings inside texts cannot end or open a turn, nor pass for a placeholder: backslashes,
``#`` and ``<`` of a text (and ``:`` of a role) are written as a backslash and a letter, so the
only such characters are the template's.  Undoing it is exact.  The loss mask covers the escaped text of assistant turns, without their
marks; roles are escaped too.

Turns are sorted by their number, then role and text, so ties have one result.  Formatting is
done turn by turn before the turns of a conversation meet; a conversation is one row in the end,
so its turns must meet in one task.

Defined results: null text is empty, a null role is empty, null turn numbers come first; a null
conversation id is a conversation of its own; repeated rows are repeated turns; unknown part
types are kept as attachments of that type without expanded tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])

#: Pixels of a side of an image patch; tokens per second of audio and per page of a document.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 512

OPEN, CLOSE = "### ", "</turn>\n"
LEARNED = "assistant"


#: What stands for a character of a text; the backslash comes first on the way in and last on the way out.
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, escaped in _ESCAPES if role else _ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def tokens_of(part: Column) -> Column:
    """Expanded token count of an attachment part; 0 for text and unknown types."""
    def patches(pixels: Column) -> Column:
        return F.ceil(F.coalesce(pixels, F.lit(0)) / PATCH)

    counted = (F.when(part["type"] == "image", patches(part["width"]) * patches(part["height"]))
               .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
               .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PER_PAGE))
    return F.coalesce(counted, F.lit(0)).cast("long")


def visit(parts: Column) -> Column:
    """struct(text, refs, tokens): escaped text with numbered placeholders, references in order, expanded tokens."""
    def step(done: Column, part: Column) -> Column:
        is_text = F.coalesce(part["type"], F.lit("text")) == "text"
        number = F.size(done["refs"]).cast("string")
        mark = F.concat(F.lit("<|"), escape(part["type"]), F.lit(":"), number, F.lit("|>"))
        return F.struct(
            F.concat(done["text"], F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)).alias("text"),
            F.when(is_text, done["refs"]).otherwise(F.concat(done["refs"], F.array(part["ref"]))).alias("refs"),
            (done["tokens"] + F.when(is_text, 0).otherwise(tokens_of(part))).alias("tokens"))

    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("refs"), F.lit(0).cast("long").alias("tokens"))
    return F.aggregate(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), empty, step)


def text_part(text: Column) -> Column:
    """Plain text as a list of one part."""
    fields = {field.name: F.lit(None).cast(field.dataType) for field in PART}
    fields |= {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*[value.alias(name) for name, value in fields.items()]).cast(PART))


def format_turns(turns: DataFrame, parts: Column, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """(conv_id, turn, role, formatted, learned, refs, tokens) per row; ``learned`` is (start, length) of the loss mask."""
    visited = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"),
                           escape(F.coalesce(F.col(role).cast("string"), F.lit("")), role=True).alias("role"), visit(parts).alias("v"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(": "))
    return visited.select(
        "conv_id", "turn", "role", F.concat(head, F.col("v.text"), F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("role") == LEARNED, F.struct(F.length(head).alias("start"), F.length("v.text").alias("length"))).alias("learned"),
        "v.refs", "v.tokens")


def format_conversations(turns: DataFrame, parts: Column, **columns: str) -> DataFrame:
    """(conv_id, formatted, mask, refs, tokens): ``mask`` lists the learned stretches (start, length) in code points."""
    rows = format_turns(turns, parts, **columns).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "formatted", "learned", "refs", "tokens"))).alias("turns"))

    def step(done: Column, t: Column) -> Column:
        here = F.when(t["learned"].isNotNull(), F.array(F.struct(
            (done["at"] + t["learned"]["start"]).alias("start"), t["learned"]["length"].alias("length"))))
        none = F.array().cast("array<struct<start:int,length:int>>")
        return F.struct((done["at"] + F.length(t["formatted"])).alias("at"), F.concat(done["mask"], F.coalesce(here, none)).alias("mask"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    return rows.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["formatted"]), "").alias("formatted"),
        F.aggregate("turns", first, step, lambda done: done["mask"]).alias("mask"),
        F.flatten(F.transform("turns", lambda t: t["refs"])).alias("refs"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("tokens"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, CLOSE, -1)  # the last is what follows the last turn: nothing
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda t: F.substring(t, F.lit(len(OPEN) + 1), F.length(t)))
    return F.transform(bodies, lambda t: F.struct(
        unescape(F.substring_index(t, ": ", 1)).alias("role"),
        unescape(F.substring(t, F.length(F.substring_index(t, ": ", 1)) + 3, F.length(t))).alias("text")))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")
