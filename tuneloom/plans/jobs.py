"""Whole jobs: prepare training batches, evaluate a model on a task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.operators.batching import adaptive_batches, tokenize_records
from tuneloom.operators.evalset import label_vocabulary
from tuneloom.operators.generate import Engine, generate_answers
from tuneloom.operators.lengths import filter_for_training, kept
from tuneloom.operators.scoring import evaluate, match_labels, predictions
from tuneloom.operators.splits import train_val_split
from tuneloom.session import job_stages, stage_table
from tuneloom.sources.records import read_eval_jsonl
from tuneloom.sources.writers import write_batches, write_eval_report


def prepare_training(records: DataFrame, tok, out: str, max_len: int = 1024,
                     batch_size: int = 4, strategy: str = "auto", val_fraction: float = 0.1,
                     seed: int = 0, shuffle: bool = True) -> dict[str, dict]:
    """Filter, tokenise once, split, lay out and write both sides; returns the layout infos.

    The token table is staged, so the texts are read and tokenised a single
    time; the split reads one narrow column of it and is drawn once. Staged tables are
    dropped at the end.
    """
    with job_stages(records.sparkSession):
        usable = kept(filter_for_training(records, tok, max_len))
        tokens = stage_table(tokenize_records(usable, tok, max_len), "tokens")
        sides = stage_table(train_val_split(tokens.select("seq"), val_fraction, seed), "sides")
        tokens = tokens.join(sides, "seq")
        infos = {}
        for name, flag in (("train", "in_train"), ("val", "in_val")):
            batches, info = adaptive_batches(tokens.where(F.col(flag)).drop("in_train", "in_val"),
                                             batch_size, max_len, strategy, shuffle, seed)
            write_batches(batches, f"{out}/{name}", tok.pad_id)
            infos[name] = info
    return infos


def evaluate_task(spark: SparkSession, test_path: str, factory: Callable[[], Engine],
                  model: str, out: str, adapter: str | None = None,
                  max_tokens: int = 8) -> DataFrame:
    """Answer a test file greedily, score it, write the report; returns the summary."""
    test = read_eval_jsonl(spark, test_path)
    answers = stage_table(generate_answers(test, factory, max_tokens), "answers")
    tag = "fine-tuned" if adapter else "base"
    scored = stage_table(predictions(
        match_labels(answers, label_vocabulary(test)).withColumn("run_id", F.lit(tag))), "scored")
    summary = (evaluate(scored).withColumn("tag", F.lit(tag)).withColumn("model", F.lit(model))
               .withColumn("adapter", F.lit(adapter).cast("string")))
    write_eval_report(summary, scored, out)
    return summary
