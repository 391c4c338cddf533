"""Classification tasks: label vocabulary, prompts, sampled train and test rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.constants import Task
from tuneloom.functions.text import strip
from tuneloom.operators.splits import sample_exact


def label_vocabulary(df: DataFrame, label: str = "gold") -> DataFrame:
    """Distinct labels."""
    return df.select(F.col(label).alias("label")).distinct()


def label_lines(vocabulary: DataFrame) -> Column:
    """The sorted vocabulary as ``- label`` lines, one value for every row.

    It is part of each prompt of a task, so it has to fit into one.
    """
    lines = F.transform(F.array_sort(F.collect_list("label")),
                        lambda x: F.concat(F.lit("- "), x))
    return vocabulary.agg(F.array_join(lines, "\n")).scalar()


def label_of(labels: list[str] | tuple[str, ...], index: Column) -> Column:
    """Label by 0-based index. An index outside the list is an error, never a wrap."""
    inside = index.between(0, len(labels) - 1)
    known = F.array(*[F.lit(x) for x in labels])
    return F.when(inside, F.get(known, index.cast("int"))).otherwise(
        F.raise_error(F.concat(F.lit("label index out of range: "),
                               F.coalesce(index.cast("string"), F.lit("null")))))


def _labels_text(task: Task, vocabulary: DataFrame | None) -> Column:
    if task.label_text_key:
        if vocabulary is None:
            raise ValueError(f"task {task.name} takes its labels from a column")
        return label_lines(vocabulary)
    return F.lit(", ".join(task.labels))


def render_task_prompt(df: DataFrame, task: Task, vocabulary: DataFrame | None = None,
                       out: str = "prompt") -> DataFrame:
    """Fill the task template. The pieces are joined, so slot names in a text stay text."""
    labels = _labels_text(task, vocabulary)
    text = strip(F.col(task.text_key).cast("string"))
    head, tail = task.template.split("{text}")
    pieces: list[Column] = []
    for part, last in ((head, text), (tail, None)):
        first, *rest = part.split("{labels}")
        pieces.append(F.lit(first))
        for piece in rest:
            pieces += [labels, F.lit(piece)]
        if last is not None:
            pieces.append(last)
    return df.withColumn(out, F.concat(*pieces))


def task_label(df: DataFrame, task: Task) -> Column:
    if task.label_text_key:
        return F.col(task.label_text_key)
    return label_of(task.labels, F.col(task.label_key))


def build_task(train: DataFrame, test: DataFrame, task: Task, n_train: int = 500,
               n_test: int = 200, seed: int = 0, key: str = "seq") -> DataFrame:
    """Sampled rows of both splits: ``split, <key>, prompt, completion | gold``.

    A label column's vocabulary comes from the whole train split, before
    sampling, and goes into the prompts of both splits.
    """
    vocabulary = (label_vocabulary(train, task.label_text_key)
                  if task.label_text_key else None)

    def side(df: DataFrame, n: int, split: str, label_column: str) -> DataFrame:
        chosen = render_task_prompt(sample_exact(df, n, seed, key), task, vocabulary)
        return chosen.select(F.lit(split).alias("split"), key, "prompt",
                             task_label(chosen, task).alias(label_column))

    return side(train, n_train, "train", "completion").unionByName(
        side(test, n_test, "test", "gold"), allowMissingColumns=True)


def label_distribution(df: DataFrame, label: str = "gold") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def majority_baseline(df: DataFrame, label: str = "gold") -> DataFrame:
    """Share of the most common label; an empty table is an error."""
    counts = label_distribution(df, label)
    return counts.agg(
        F.sum("n").alias("n"), F.max("n").alias("majority_n")).select(
        F.coalesce("n", F.raise_error(F.lit("no rows to score"))).alias("n"), "majority_n",
        (F.col("majority_n") / F.col("n")).alias("majority_baseline"))
