"""Generation requests and response documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tuneloom.constants import (CHAT_ROUTE, COMPLETION_ROUTE, DEFAULT_MAX_TOKENS,
                                DEFAULT_TEMPERATURE)
from tuneloom.functions.text import first_present, word_count
from tuneloom.operators.chat import chat_lines, instruct_prompt
from tuneloom.schemas import MESSAGES, REQUEST_BODY


def parse_requests(df: DataFrame, chat_style: str = "instruct") -> DataFrame:
    """``(request_id, route, body)`` to typed requests with defaults.

    ``reason`` is set on rows that cannot be answered: an unknown route, or a bad
    request, whose body is no JSON object of these fields or whose numbers are none.
    Any other request goes on. ``stream`` is true for every value but null, false, 0
    and empty ones. Split the result with ``accepted`` and ``rejected``.
    """
    shape = StructType([*REQUEST_BODY.fields, StructField("_broken", StringType())])
    body = F.from_json(first_present(F.col("body")), shape,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    tokens = F.col("_b.max_tokens").try_cast("double").try_cast("int")
    temperature = F.col("_b.temperature").try_cast("double")
    bad = (F.col("_b._broken").isNotNull()
           | (F.col("_b.max_tokens").isNotNull() & tokens.isNull())
           | (F.col("_b.temperature").isNotNull() & temperature.isNull()))
    falsy = F.lower(F.col("_b.stream")).isin("", "false", "0", "0.0", "[]", "{}")
    messages = F.coalesce(F.col("_b.messages"), F.array().cast(MESSAGES))
    render = {"plain": chat_lines, "instruct": instruct_prompt}[chat_style]
    is_chat = F.col("route") == CHAT_ROUTE
    known = is_chat | (F.col("route") == COMPLETION_ROUTE)
    return (df.withColumn("_b", body)
            .withColumn("kind", F.when(is_chat, "chat").otherwise("completion"))
            .withColumn("reason", F.when(~F.coalesce(known, F.lit(False)), "unknown route")
                        .when(F.coalesce(bad, F.lit(False)), "bad request"))
            .withColumn("prompt", F.when(is_chat, render(messages))
                        .otherwise(F.coalesce("_b.prompt", F.lit(""))))
            .withColumn("max_tokens", F.coalesce(tokens, F.lit(DEFAULT_MAX_TOKENS)))
            .withColumn("temperature", F.coalesce(temperature, F.lit(DEFAULT_TEMPERATURE)))
            .withColumn("stream", F.coalesce(~falsy, F.lit(False)))
            .drop("_b", "body"))


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("reason").isNull()).drop("reason")


def rejected(requests: DataFrame) -> DataFrame:
    """Requests without an answer, with the HTTP status they would get."""
    return requests.where(F.col("reason").isNotNull()).select(
        "request_id", "route", "reason",
        F.when(F.col("reason") == "bad request", 400).otherwise(404).alias("status"))


def response_envelope(df: DataFrame, model: str, created: int | None = None) -> DataFrame:
    """Add ``response``: the JSON answer document for ``(request_id, kind, text)``.

    The id is derived from the request id, so a retry writes the same document.
    """
    short = F.substring(F.md5(F.col("request_id").cast("string")), 1, 8)
    stamp = F.unix_timestamp() if created is None else F.lit(created).cast("bigint")
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    finish = F.lit("stop").alias("finish_reason")
    index = F.lit(0).alias("index")

    def document(prefix: str, kind: str, choice, *extra):
        return F.to_json(F.struct(
            F.concat(F.lit(prefix), short).alias("id"), F.lit(kind).alias("object"),
            stamp.alias("created"), F.lit(model).alias("model"),
            F.array(choice).alias("choices"), *extra))

    chat = document("chatcmpl-", "chat.completion",
                    F.struct(index, finish, message.alias("message")),
                    F.struct(word_count("text").alias("completion_tokens")).alias("usage"))
    plain = document("cmpl-", "text_completion",
                     F.struct(index, F.col("text").alias("text"), finish))
    return df.withColumn("response", F.when(F.col("kind") == "chat", chat).otherwise(plain))
