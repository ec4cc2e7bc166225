"""Chat formatting: one training example for each assistant turn, the turns before it as context.

Template of a turn: ``### role: text </turn>`` and a line feed. In roles and texts
the backslash becomes ``\\b``, ``#`` becomes ``\\h``, ``<`` becomes ``\\l`` and, in roles,
``:`` becomes ``\\c``; so no text can open or close a turn, and reading undoes it.

Only built-in DataFrame functions are used. A conversation is the unit of work, as
each of its examples holds all turns before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    for plain, code in (("#", "\\h"), ("<", "\\l"), *(((":", "\\c"),) if role else ())):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for plain, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_examples(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Examples of each conversation: conv_id, example (from 1), last, context, target, trainable.

    The text of an example is context followed by target. Only the reply, target
    without the closing mark, is trained on, and only where trainable. Turns after the
    last reply, or a conversation without one, get a last example of context alone.
    Rows are ordered by turn, ties by role and text; a null turn comes first, null
    role and text are empty, rows with null conv_id make one conversation, repeated
    rows are turns of their own. A conversation is one row, and its examples hold its
    text as often as it has replies, so very long ones of many turns should be split
    before. Other columns are ignored; no rows give no rows.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(": "))
    laid = grouped.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))).alias("whole"),
        F.transform("turns", head).alias("heads"),
        F.transform("turns", lambda t: F.concat(escape(t["text"]), F.lit(CLOSE))).alias("replies"),
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda i: (F.element_at("turns", i)["role"] == assistant) | (i == F.size("turns")),
        ).alias("ends"),
        F.transform("turns", lambda t: t["role"] == assistant).alias("by_assistant"),
    )
    each = laid.select("*", F.posexplode("ends").alias("n", "at"))
    own = F.element_at("by_assistant", F.col("at"))
    before = F.array_join(F.slice("whole", F.lit(1), F.col("at") - 1), "")
    return each.select(
        "conv_id",
        (F.col("n") + 1).alias("example"),
        (F.col("n") + 1 == F.size("ends")).alias("last"),
        F.concat(before, F.when(own, F.element_at("heads", F.col("at"))).otherwise(F.element_at("whole", F.col("at")))).alias("context"),
        F.when(own, F.element_at("replies", F.col("at"))).otherwise(F.lit("")).alias("target"),
        own.alias("trainable"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text, as they were before escaping."""
    marked = F.filter(F.split(text, OPEN, -1), lambda x: x != "")
    body = F.transform(marked, lambda x: F.replace(x, F.lit(CLOSE), F.lit("")))

    def parsed(x: Column) -> Column:
        at = F.instr(x, F.lit(": "))
        return F.struct(
            unescape(F.substring(x, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(x, at + 2, F.length(x))).alias("text"),
        )

    return F.transform(body, parsed)


def read_examples(examples: DataFrame) -> DataFrame:
    """What the examples say, read back: a row for each conversation.

    n_turns and turns_sha256 come from the last example, which holds every turn; the
    loss columns come from all trainable targets in order.
    """
    reply = unescape(F.regexp_extract("target", r"(?s)^([^<]*) </turn>\n$", 1))
    turns = read_turns(F.concat("context", "target"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        F.when(F.col("last"), F.size(turns)).alias("n"),
        F.when(F.col("last"), F.sha2(said, 256)).alias("sha"),
        F.when(F.col("trainable"), F.struct("example", reply.alias("reply"))).alias("loss"),
        (F.length("context") + F.length("target")).cast("long").alias("chars"),
    )
    loss = F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["reply"]), "")
    return (
        read.groupBy("conv_id")
        .agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
