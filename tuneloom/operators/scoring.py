"""Exact-match scoring of generated answers against a label vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tuneloom.functions.text import norm_label, preview
from tuneloom.operators.ranks import SHARD_ROWS, prefix_aggregates
from tuneloom.session import stage_table

#: A vocabulary of at most so many labels, and characters of them, is shipped to every task.
AUTOMATON_LABELS = 1 << 16
AUTOMATON_CHARS = 1 << 21
# Characters of the pieces that answers and labels are joined on.
_GRAM = 3


def _vocabulary(df: DataFrame) -> DataFrame:
    return df.select("label", norm_label("label").alias("norm"))


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)) \
        .otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, size))


def _rarest_pieces(names: DataFrame) -> DataFrame:
    """Each normal form with the piece of it that fewest others have; short ones as a whole."""
    whole = F.length("norm") <= _GRAM
    every = names.withColumn("piece", F.explode(F.array_distinct(F.when(
        whole, F.array("norm")).otherwise(_pieces(F.col("norm"), _GRAM)))))
    common = every.groupBy("piece").agg(F.count("*").alias("_uses"))
    return (every.join(common, "piece").groupBy("norm", "label", "same")
            .agg(F.min(F.struct("_uses", "piece"))["piece"].alias("piece")))


class _Automaton:
    """Finds all labels that a text holds in one pass over it."""

    def __init__(self, names: list[Row]):
        self.labels = {r.norm: r.label if r.same == 1 else None for r in names}
        self.trie = ahocorasick.Automaton()
        for norm in filter(None, self.labels):
            self.trie.add_word(norm, norm)
        self.trie.make_automaton()
        self.inside: dict[str, set[str]] = {}

    def held(self, text: str) -> set[str]:
        found = {norm for _, norm in self.trie.iter(text)} if len(self.trie) else set()
        return found | {""} if "" in self.labels else found

    def covered(self, norm: str) -> set[str]:
        """The other labels that a label holds."""
        if norm not in self.inside:
            self.inside[norm] = self.held(norm) - {norm}
        return self.inside[norm]

    def named(self, text: str | None) -> str | None:
        if text is None:
            return None
        hits = self.held(text)
        top = [self.labels[norm] for norm in hits.difference(*map(self.covered, hits))]
        single = [label for label in top if label is not None]
        return single[0] if len(single) == 1 else None


def _by_automaton(names: list[Row]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _Automaton(names)
        for texts in batches:
            yield pd.Series([automaton.named(t) for t in texts], dtype=object)
    return named


def _by_pieces(outputs: DataFrame, names: DataFrame, text: str, key: str, out: str) -> DataFrame:
    """Labels looked up by their rarest pieces, for vocabularies of any size."""
    # the generator keeps the normal form from being pushed into its uses and made again
    answers = outputs.select(key, F.explode(F.array(norm_label(text))).alias("_norm")).where(
        F.col("_norm").isNotNull())
    pieces = F.array_distinct(F.concat(F.array(F.lit("")), *[
        _pieces(F.col("_norm"), size) for size in range(1, _GRAM + 1)]))
    met = (answers.select(key, F.explode(pieces).alias("piece"))
           .join(_rarest_pieces(names), "piece").drop("piece"))
    held = met.join(answers, key).where(F.contains("_norm", "norm"))
    hits = held.groupBy(key).agg(F.collect_list(F.struct("label", "norm", "same")).alias("_hits"))
    top = F.filter(F.col("_hits"), lambda a: (a["same"] == 1) & ~F.exists(
        F.col("_hits"), lambda b: (a["norm"] != b["norm"]) & F.contains(b["norm"], a["norm"])))
    found = (hits.withColumn("_top", F.explode(F.array(top)))
             .where(F.size("_top") == 1).select(key, F.get("_top", F.lit(0))["label"].alias(out)))
    return outputs.join(found, key, "left")


def match_labels(outputs: DataFrame, labels: DataFrame, text: str = "raw", key: str = "seq",
                 out: str = "pred", automaton_labels: int = AUTOMATON_LABELS) -> DataFrame:
    """Add the single label that ``text`` names, or null.

    A label is named when the answer holds its normal form and no other label that holds it in
    turn; labels that share a normal form cancel each other, and still cover what they contain.
    The vocabulary is counted first. Up to ``automaton_labels`` labels of AUTOMATON_CHARS
    characters in all become an automaton that every task builds once: an answer is read in one
    pass and no row moves. Above that every label is looked up by its rarest piece of three
    characters, so that an answer meets few labels it does not hold, however many there are.
    ``key`` identifies a row of ``outputs``; ``labels`` has distinct ``label``, null ones name
    nothing. Null answers have no label.
    """
    names = stage_table(_vocabulary(labels.where(F.col("label").isNotNull())).groupBy("norm")
                        .agg(F.min("label").alias("label"), F.count("*").alias("same")), "names")
    chars = F.coalesce(F.sum(F.length("norm") + F.length("label")), F.lit(0))
    size = names.agg(F.count("*").alias("n"), chars.alias("chars")).first()
    if size.n <= automaton_labels and size.chars <= AUTOMATON_CHARS:
        return outputs.withColumn(out, _by_automaton(names.collect())(norm_label(text)))
    return _by_pieces(outputs, names, text, key, out)


def ambiguous_labels(labels: DataFrame) -> DataFrame:
    """Normal forms shared by several labels; answers naming them can never be scored."""
    return (_vocabulary(labels).groupBy("norm")
            .agg(F.countDistinct("label").alias("labels")).where("labels > 1"))


def is_correct(pred: str = "pred", gold: str = "gold") -> Column:
    return F.coalesce(F.col(pred) == F.col(gold), F.lit(False))


def predictions(df: DataFrame, text: str = "raw") -> DataFrame:
    """The stored prediction table; only a preview of the answer is kept."""
    return df.select("run_id", "seq", "gold", "pred", preview(text).alias("raw"))


def _outcomes(preds: DataFrame, by: list[str], seconds: str | None) -> DataFrame:
    """Counts per (run, gold, pred): every report is a roll-up of this small table."""
    spent = F.sum(seconds) if seconds else F.lit(None).cast("double")
    return preds.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"),
                                                  spent.alias("seconds"))


def evaluate(preds: DataFrame, by: tuple[str, ...] = ("run_id",),
             seconds: str | None = None) -> DataFrame:
    """Accuracy report per run; a missing prediction counts as wrong."""
    outcomes = _outcomes(preds, list(by), seconds)
    per_gold = outcomes.groupBy(*by, "gold").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(is_correct(), F.col("n")).otherwise(0)).alias("correct"),
        F.sum(F.when(F.col("pred").isNull(), F.col("n")).otherwise(0)).alias("unparseable"),
        F.sum("seconds").alias("seconds"))
    n = F.col("n")
    return (per_gold.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"),
        F.sum("unparseable").alias("unparseable"), F.max("n").alias("_majority"),
        F.sum("seconds").alias("seconds"))
        .withColumn("accuracy", F.col("correct") / n)
        .withColumn("majority_baseline", F.col("_majority") / n)
        .withColumn("examples_per_s", F.when(F.col("seconds") > 0, n / F.col("seconds")))
        .drop("_majority"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Refuse an empty table."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def prediction_distribution(preds: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Rows per predicted label, with the null bucket."""
    return preds.groupBy(*by, "pred").agg(F.count("*").alias("n"))


def counter_map(df: DataFrame, by: list[str], label: str, n: str = "n",
                out: str = "counts") -> DataFrame:
    """Label counts as a map; a null label gets the key ``<none>``.

    One entry per distinct label, so it suits vocabularies, not free text.
    """
    pair = F.struct(F.coalesce(F.col(label), F.lit("<none>")), F.col(n))
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(pair)))
                               .alias(out))


def running_accuracy(preds: DataFrame, every: int = 50,
                     shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Accuracy so far, reported after each ``every`` rows of a run."""
    running = prefix_aggregates(
        preds.select("run_id", "seq", "gold", "pred"), ["run_id"], "seq",
        {"i": ("sum", F.lit(1).cast("bigint")),
         "correct": ("sum", is_correct().cast("bigint"))}, shard_rows=shard_rows)
    return (running.where(F.col("i") % every == 0)
            .select("run_id", "i", "correct", (F.col("correct") / F.col("i")).alias("accuracy")))


def compare_runs(reports: DataFrame) -> DataFrame:
    """Base and tuned accuracy side by side per (model, task), with the gain."""
    wide = (reports.groupBy("model", "task")
            .pivot("tag", ["base", "fine-tuned"])
            .agg(F.first("accuracy").alias("a"), F.first("majority_baseline").alias("m")))
    base, tuned = F.col("base_a"), F.col("`fine-tuned_a`")
    return wide.select(
        "model", "task", base.alias("base"), tuned.alias("tuned"),
        (tuned - base).alias("gain"),
        (base < F.col("base_m")).alias("base_below_majority"),
        (tuned < F.col("`fine-tuned_m`")).alias("tuned_below_majority"))
