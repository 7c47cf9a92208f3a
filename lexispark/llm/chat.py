"""Operator 5: prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it as context, then
the reply, which alone lies under the loss mask [loss_start, loss_end) in code points. A
conversation that doesn't end with an assistant turn has one more example, of all its
turns, with nothing under the mask, so that nothing of it is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn. Inside roles and texts, each
``<``, backslashes, ``|`` gets one more backslash, which reading takes away again, and a
line break in a role is written as a control string; so no text can close a turn.

Rows: a null role or text is empty; turns with equal numbers go by role, then text; null
turn numbers come first; repeated rows are turns of their own; null ids are one
conversation; an empty table has no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|br|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (position of the reply among the turns), formatted, loss_start,
    loss_end, whole (true for the example that shows all turns)."""
    role = F.coalesce(turns[role_col], F.lit(""))
    text = F.coalesce(turns[text_col], F.lit(""))
    convs = (
        turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), role.alias("role"), text.alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )
    head = lambda t: F.concat(F.lit(START), F.regexp_replace(escape(t["role"]), "\n", BREAK.replace("|", r"|")), F.lit("\n"))
    shown = convs.select(
        "conv_id",
        F.explode(F.array(F.struct(F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("reply"))).alias("turns")))).alias("c"),
    ).select("conv_id", F.col("c.turns").alias("turns"))
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["reply"] | (i == last))
    joined = lambda part: F.array_join(F.transform(part, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    one = shown.select("conv_id", "turns", F.explode(targets).alias("example"))
    one = one.select("conv_id", "example", (F.col("example") == last).alias("whole"), joined(F.slice("turns", F.lit(1), F.col("example"))).alias("context"), F.get("turns", F.col("example")).alias("t"))
    n = F.length("context") + F.length("t.head")
    return one.select(
        "conv_id",
        "example",
        F.concat("context", "t.head", "t.body", F.lit(END + "\n")).alias("formatted"),
        n.alias("loss_start"),
        F.when(F.col("t.reply"), n + F.length("t.body")).otherwise(n).alias("loss_end"),
        "whole",
    )


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of an example, from its characters alone."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring_index(F.substr(p, F.length(role) + 2), END, 1)
        return F.struct(unescape(F.regexp_replace(role, r"<\|br\|>", "\n")).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask."""
    return unescape(F.substr(formatted, start + 1, end - start))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from them."""
    turns = F.when(F.col("whole"), read_turns(F.col("formatted")))
    read = examples.select("conv_id", "example", F.length("formatted").alias("chars"), turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    by = read.groupBy("conv_id").agg(
        F.max(F.size("turns")).alias("n_turns"),
        F.max(F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)).alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return by.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
