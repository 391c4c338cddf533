"""Loose instruction records to one shape: ``(record_id, seq, kind, prompt, completion, text)``.

``kind`` is ``pair`` (templated prompt and completion), ``text`` (plain text) or
``chat`` (a prompt that is already rendered, and a completion).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneloom.constants import (COMPLETION_KEYS, CONTEXT_HEAD, CONTEXT_KEYS, INSTRUCTION_HEAD,
                                PROMPT_KEYS, RESPONSE_HEAD, TEXT_KEYS)
from tuneloom.operators.chat import instruct_prompt


def _sql_text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("\n", "\\n").replace("'", "\\'")
    return f"'{escaped}'"


def _field(df: DataFrame, name: str) -> str:
    if isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType)):
        return f"to_json(`{name}`)"
    return f"CAST(`{name}` AS STRING)"


def _first_field(df: DataFrame, names: tuple[str, ...]) -> str:
    """First of the fields that is neither null nor the empty string."""
    found = [f"nullif({_field(df, name)}, '')" for name in names if name in df.columns]
    return f"coalesce({', '.join([*found, 'CAST(NULL AS STRING)'])})"


def messages_to_pair(messages: Column) -> tuple[Column, Column]:
    """Prompt and completion of a chat record: the loss is on the last assistant turn.

    Turns after it have no answer to learn from. Both are null when there is no
    assistant turn or nothing before it.
    """
    last = F.array_max(F.transform(
        messages, lambda m, i: F.when(m["role"] == "assistant", i + 1)))
    head = F.slice(messages, F.lit(1), F.coalesce(last - 1, F.lit(0)))
    usable = last > 1
    prompt = F.when(usable, instruct_prompt(head))
    completion = F.when(usable, F.get(messages, last - 1)["content"])
    return prompt, completion


def messages_to_pairs(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``prompt`` and ``completion`` taken from a chat column."""
    prompt, completion = messages_to_pair(F.col(messages))
    return df.withColumn("prompt", prompt).withColumn("completion", completion)


def normalize_records(df: DataFrame, chat: bool = False) -> DataFrame:
    """Map every raw row to an SFT record; ``kind`` is null for unusable rows.

    A pair needs a prompt and a completion, otherwise the row falls through to
    its plain text. Chat rows are only used with ``chat=True``.
    """
    # found first, combined second: each lookup is one column, not a repeated expression
    found = df.selectExpr(
        *[c for c in df.columns if c in ("record_id", "seq") or (chat and c == "messages")],
        f"{_first_field(df, PROMPT_KEYS)} AS _prompt",
        f"{_first_field(df, COMPLETION_KEYS)} AS _completion",
        f"{_first_field(df, CONTEXT_KEYS)} AS _context", f"{_first_field(df, TEXT_KEYS)} AS _text")
    if chat and "messages" in df.columns:
        chat_prompt, chat_completion = messages_to_pair(F.col("messages"))
        found = found.withColumns({"_chat": chat_prompt, "_answer": chat_completion})
    else:
        found = found.selectExpr("*", "CAST(NULL AS STRING) AS _chat",
                                 "CAST(NULL AS STRING) AS _answer")
    return found.selectExpr("*", """
        CASE WHEN _prompt IS NOT NULL AND _completion IS NOT NULL THEN 'pair'
             WHEN _text IS NOT NULL THEN 'text'
             WHEN _chat IS NOT NULL AND _answer IS NOT NULL THEN 'chat' END AS kind
        """).selectExpr("record_id", "seq", "kind", f"""
        CASE kind WHEN 'chat' THEN _chat
             WHEN 'pair' THEN CASE WHEN _context <> _prompt
                 THEN concat(_prompt, {_sql_text(CONTEXT_HEAD)}, _context) ELSE _prompt END
             END AS prompt
        """, "CASE kind WHEN 'pair' THEN _completion WHEN 'chat' THEN _answer END AS completion",
        "CASE kind WHEN 'text' THEN _text END AS text")


def drop_unusable(df: DataFrame) -> DataFrame:
    return df.where(F.col("kind").isNotNull())


_PROMPT_TEXT = f"""
    CASE kind WHEN 'chat' THEN prompt
              WHEN 'pair' THEN concat({_sql_text(INSTRUCTION_HEAD)}, prompt,
                                      {_sql_text(RESPONSE_HEAD)}) END"""


def prompt_text() -> Column:
    """The prompt as the model sees it; null for plain text."""
    return F.expr(_PROMPT_TEXT)


def rendered_text() -> Column:
    return F.expr(f"CASE WHEN kind = 'text' THEN text ELSE concat({_PROMPT_TEXT}, completion) END")


def render(df: DataFrame, out: str = "rendered") -> DataFrame:
    return df.withColumn(out, rendered_text())


def coerce_shape(df: DataFrame) -> DataFrame:
    """Choose the shape of each row: pair, messages, text, otherwise the row as JSON text."""
    def has(*names: str) -> Column:
        if any(n not in df.columns for n in names):
            return F.lit(False)
        found = F.lit(True)
        for n in names:
            found = found & F.col(n).isNotNull()
        return found

    payload = F.to_json(F.struct(*[c for c in df.columns if c not in ("record_id", "seq")]))
    pair, messages, text = has("prompt", "completion"), has("messages"), has("text")
    plain = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("shape", F.when(pair, "pair").when(messages, "messages")
                          .when(text, "text").otherwise("json"))
            .withColumn("text", F.when(pair | messages, F.lit(None).cast("string"))
                        .when(text, plain).otherwise(payload)))


def coerce_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Choose the shape of raw JSON lines of any keys, which no schema has to name.

    Adds ``shape`` (pair, messages, text, json, or broken for what is no JSON object) and
    ``text``: that of a text, the whole line with sorted keys where no shape fits, else null. A
    key with a null value counts as missing.
    """
    record = F.try_parse_json(F.col(value))

    def has(key: str) -> Column:
        found = F.try_variant_get(F.col("_line"), f"$.{key}", "variant")
        return F.coalesce(F.schema_of_variant(found) != "VOID", F.lit(False))

    parsed = df.withColumn("_line", record)
    shape = (F.when(~F.coalesce(F.schema_of_variant("_line").startswith("OBJECT"), F.lit(False)),
                    "broken")
             .when(has("prompt") & has("completion"), "pair").when(has("messages"), "messages")
             .when(has("text"), "text").otherwise("json"))
    text = F.when(shape == "text", F.try_variant_get("_line", "$.text", "string")).when(
        shape == "json", F.to_json("_line"))
    return parsed.withColumns({"shape": shape, "text": text}).drop("_line")
