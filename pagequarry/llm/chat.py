r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and
the reply itself as the only text under the loss mask. Turns after the last reply would
be in no example, so a conversation that ends otherwise gets one more, without a mask.

A turn is written ``### role: text</turn>`` and a newline. Inside texts and roles ``\``,
``#`` and ``<`` (in roles ``:`` too) become ``\b``, ``\h``, ``\l`` and ``\c``, so no text
can look like a mark and the way back is exact.

Defined results: a null text or role counts as empty; turns are ordered by turn (null
first), then role, then text, and repeated rows are repeated turns; rows with a null
``conv_id`` are one conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "assistant"
MARKS = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_MARKS = (*MARKS, (":", "\\c"))
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column, marks=MARKS) -> Column:
    for plain, mark in marks:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column, marks=MARKS) -> Column:
    for plain, mark in reversed(marks):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """``(conv_id, example, formatted, loss_start, loss_length)``, one row per example.

    ``loss_start`` counts code points from 0; both are null in an example without a mask.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    whole = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = whole.groupBy("conv_id").agg(turns.alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_MARKS), F.lit(BETWEEN))
    whole = whole.select(
        "conv_id",
        "turns",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))).alias("written"),
        F.transform("turns", lambda t: F.char_length(head(t))).alias("heads"),
        F.transform("turns", lambda t: F.char_length(escape(t["text"]))).alias("lengths"),
    )
    last = F.size("turns") - 1
    each = whole.select("*", F.posexplode("turns").alias("at", "own")).filter(
        (F.col("own.role") == REPLY) | (F.col("at") == last)
    )
    masked = F.col("own.role") == REPLY
    before = F.array_join(F.slice("written", F.lit(1), F.col("at")), "")
    each = each.select("conv_id", "at", masked.alias("masked"), "heads", "lengths", "written", before.alias("before"))
    place = F.char_length("before") + F.col("heads")[F.col("at")]
    return each.select(
        "conv_id",
        F.col("at").cast("long").alias("example"),
        F.concat("before", F.col("written")[F.col("at")]).alias("formatted"),
        F.when(F.col("masked"), place).alias("loss_start"),
        F.when(F.col("masked"), F.col("lengths")[F.col("at")]).alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda p: F.instr(p, BETWEEN)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1), ROLE_MARKS).alias("role"),
            unescape(F.substring(p, cut(p) + len(BETWEEN), F.char_length(p))).alias("text"),
        ),
    )


def digests(made: DataFrame) -> DataFrame:
    """What reading the examples back gives, a row per conversation."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    read = made.select(
        "conv_id", "example", F.coalesce(loss, F.lit("")).alias("loss"), F.char_length("formatted").alias("chars"), "formatted"
    )
    per = read.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.max_by("formatted", "example").alias("longest"),
    )
    per = per.withColumn("turns", parse(F.col("longest")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
