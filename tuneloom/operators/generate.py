"""Batch generation: requests in small slices through a model engine on the executors, or
answered from a table of next words by joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneloom.functions.text import strip, words
from tuneloom.session import stage_table

#: Different words from a prompt's end that are looked up before all others.
NEAR = 8


class Engine(Protocol):
    """What ``batch_generate`` needs from a model. Built once per task by a factory."""

    pad_id: int

    def encode(self, text: str) -> list[int]: ...

    def generate(self, ids: np.ndarray, mask: np.ndarray, max_new: int,
                 temperature: float) -> list[list[int]]:
        """New token ids for each left-padded row."""

    def decode(self, ids: list[int]) -> str: ...


def _answer(engine: Engine, rows: pd.DataFrame, max_len: int) -> list[str]:
    """One slice: a common temperature and the longest wish; each row keeps its own share."""
    prompts = [list(engine.encode(p))[:max_len] for p in rows["prompt"]]
    width = max((len(p) for p in prompts), default=0)
    ids = np.full((len(prompts), width), engine.pad_id, dtype=np.int64)
    mask = np.zeros_like(ids)
    for i, prompt in enumerate(prompts):
        if prompt:
            ids[i, width - len(prompt):] = prompt
            mask[i, width - len(prompt):] = 1
    wishes = [int(x) for x in rows["max_tokens"]]
    new = engine.generate(ids, mask, max(wishes), float(rows["temperature"].iloc[0]))
    return [engine.decode(list(out)[:max(wish, 0)]).strip() for out, wish in zip(new, wishes)]


def _slices(rows: pd.DataFrame, max_batch: int) -> Iterator[pd.DataFrame]:
    """Runs of equal temperature, cut to ``max_batch`` rows."""
    run = (rows["temperature"] != rows["temperature"].shift()).cumsum()
    for _, same in rows.groupby(run, sort=False):
        for start in range(0, len(same), max_batch):
            yield same.iloc[start:start + max_batch]


def batch_generate(df: DataFrame, factory: Callable[[], Engine] | DataFrame, max_batch: int = 8,
                   max_len: int = 2048, key: str = "request_id",
                   partitions: int | None = None) -> DataFrame:
    """Add ``text`` to rows of ``(key, prompt, max_tokens, temperature)``.

    Rows are spread by their key, so one common temperature cannot fill a
    single task, then sorted by temperature and prompt length inside each
    partition; every slice has one temperature and similar lengths.

    Instead of an engine's factory a table of ``learn_successors`` can answer, by
    ``follow_successors``: then nothing is sliced, and no prompt is cut at ``max_len``.
    """
    if isinstance(factory, DataFrame):
        return follow_successors(df, factory)
    spread = df.repartition(partitions, key) if partitions else df.repartition(key)
    ordered = (spread.withColumn("_size", F.length("prompt"))
               .sortWithinPartitions("temperature", "_size", key).drop("_size"))
    schema = T.StructType([*ordered.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        rest: pd.DataFrame | None = None
        for batch in batches:
            engine = engine or factory()
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            parts = list(_slices(rows, max_batch))
            # the last slice may go on in the next Arrow batch
            rest = parts.pop() if parts and len(parts[-1]) < max_batch else None
            for part in parts:
                yield part.assign(text=_answer(engine, part, max_len))
        if rest is not None and len(rest):
            yield rest.assign(text=_answer(engine, rest, max_len))

    return ordered.mapInPandas(run, schema)


def generate_answers(test: DataFrame, factory: Callable[[], Engine] | DataFrame, max_tokens: int = 8,
                     key: str = "seq", max_batch: int = 8) -> DataFrame:
    """Evaluation answers: greedy, short; the answer goes to ``raw``."""
    asked = (test.withColumn("max_tokens", F.lit(max_tokens))
             .withColumn("temperature", F.lit(0.0)))
    return (batch_generate(asked, factory, max_batch, key=key)
            .withColumnRenamed("text", "raw").drop("max_tokens", "temperature"))


def learn_successors(texts: DataFrame) -> DataFrame:
    """``(word, next)``: the most frequent next word of every word that one follows.

    Counted over all rows of a ``text`` column; ties go to the smaller word. All words are
    kept, however many there are.
    """
    rows = texts.select(words("text").alias("_w"))
    steps = rows.select(F.explode(F.arrays_zip(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))).alias("word"),
        F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))).alias("next"))).alias("s"))
    return (steps.groupBy("s.word", "s.next").agg(F.count("*").alias("n"))
            .groupBy("word").agg(F.min(F.struct(-F.col("n"), "next"))["next"].alias("next")))


def _walks(begins: DataFrame, successors: DataFrame) -> DataFrame:
    """``(_first, max_tokens)`` to ``(_first, _words)``: each first word and those that follow it,
    as many as the longest wish for it.

    A table of next words joined with itself gives the words two, four, eight steps on. A walk
    is halved with them, the longest leap first, until all its words are there; so the number of
    joins is the logarithm of the longest wish.
    """
    most = begins.agg(F.max("max_tokens")).first()[0] or 0
    # a walk only meets words that are some word's next one
    met = successors.select(F.col("next").alias("word")).distinct()
    leaps = [stage_table(successors.join(met, "word", "left_semi"), "leaps")] if most > 1 else []
    while 1 << len(leaps) < most:
        a, b = leaps[-1].alias("a"), leaps[-1].alias("b")
        leaps.append(stage_table(a.join(b, F.col("a.next") == F.col("b.word"))
                                 .select("a.word", "b.next"), "leaps"))
    steps = (begins.groupBy("_first").agg(F.max("max_tokens").alias("need"))
             .select("_first", "need", F.lit(0).cast("bigint").alias("at"),
                     F.col("_first").alias("here")))
    for k, leap in reversed([*enumerate(leaps)]):
        there = F.col("at") + (1 << k)
        halves = F.array(F.struct("at", F.col("here")), F.when(
            F.col("next").isNotNull(), F.struct(there.alias("at"), F.col("next").alias("here"))))
        steps = (steps.join(leap, (F.col("here") == F.col("word")) & (there < F.col("need")), "left")
                 .select("_first", "need", F.explode(F.array_compact(halves)).alias("s"))
                 .select("_first", "need", "s.*"))
    return steps.groupBy("_first").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "here"))), lambda s: s["here"]).alias("_words"))


def follow_successors(df: DataFrame, successors: DataFrame) -> DataFrame:
    """Add ``text`` to rows of ``(prompt, max_tokens)``: the walk through a table of
    ``(word, next)`` from the last word of the whole prompt that has a next one, until
    ``max_tokens`` words are said or a word has none.

    The last words of a prompt are looked up first, the others only where none of them has a
    next one. Rows keep their own number, so their keys may repeat or be null. Prompts without
    such a word, or that are null, get the empty text.
    """
    rows = stage_table(df.withColumn("_row", F.monotonically_increasing_id()), "asked")
    successors = stage_table(successors.select("word", "next"), "successors")

    def begun(asked: DataFrame, start: int, length: Column) -> DataFrame:
        back = asked.select("_row", "max_tokens",
                            F.array_distinct(F.reverse(words("prompt"))).alias("_back"))
        return stage_table(
            back.select("_row", "max_tokens", F.posexplode(
                F.slice("_back", F.lit(start), length)).alias("_pos", "word"))
            .join(successors, "word").groupBy("_row").agg(
                F.first("max_tokens").alias("max_tokens"), F.min_by("next", "_pos").alias("_first")),
            "begins")

    asked = rows.where(F.col("max_tokens") > 0)
    near = begun(asked, 1, F.lit(NEAR))
    far = begun(asked.join(near, "_row", "left_anti"), NEAR + 1,
                F.greatest(F.size("_back") - NEAR, F.lit(0)))
    begins = near.unionByName(far)
    told = F.slice("_words", F.lit(1), F.greatest("max_tokens", F.lit(0)))
    return (rows.join(begins.select("_row", "_first"), "_row", "left")
            .join(_walks(begins, successors), "_first", "left")
            .withColumn("text", strip(F.coalesce(F.array_join(told, " "), F.lit(""))))
            .drop("_row", "_first", "_words"))
