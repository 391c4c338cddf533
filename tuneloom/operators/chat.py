"""Chat messages to prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.constants import INSTRUCTION_HEAD, RESPONSE_HEAD


def chat_lines(messages: Column) -> Column:
    """One ``role: content`` line per message."""
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.array_join(lines, "\n")


def instruct_prompt(messages: Column) -> Column:
    """A lone user message as an instruction, anything else as lines that end in a cue."""
    first = F.get(messages, F.lit(0))
    lone = (F.size(messages) == 1) & (first["role"] == "user")
    return F.when(lone, F.concat(F.lit(INSTRUCTION_HEAD), first["content"],
                                 F.lit(RESPONSE_HEAD))).otherwise(
        F.concat(chat_lines(messages), F.lit("\nassistant:")))


def render_chat(df: DataFrame, style: str = "plain", messages: str = "messages",
                out: str = "rendered") -> DataFrame:
    styles = {"plain": chat_lines, "instruct": instruct_prompt}
    if style not in styles:
        raise ValueError(f"style must be one of {sorted(styles)}")
    return df.withColumn(out, styles[style](F.col(messages)))


def answer_spans(messages: Column, role: str = "assistant") -> Column:
    """Where the contents of a role's messages lie in ``chat_lines``, end exclusive.

    Messages with a null role or content are not in the lines, nor here.
    """
    shown = F.filter(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    sizes = F.transform(shown, lambda m: F.struct(
        (F.char_length(m["role"]) + 2).alias("head"), F.char_length(m["content"]).alias("body"),
        (m["role"] == role).alias("own")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda done, s: F.struct(
            (done["at"] + s["head"] + s["body"] + 1).alias("at"),
            F.when(s["own"], F.array_append(done["spans"], F.struct(
                (done["at"] + s["head"]).alias("start"),
                (done["at"] + s["head"] + s["body"]).alias("end"))))
            .otherwise(done["spans"]).alias("spans")), lambda done: done["spans"])
