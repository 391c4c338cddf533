"""Sinks: task splits, evaluation reports, batches that can be opened at any step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.operators.batching import pad_right


#: Batches in one file of a written set.
FILE_BATCHES = 4096
#: Predictions in one file of a report, and in a chunk of a nested one.
REPORT_ROWS, CHUNK_ROWS = 1_000_000, 10_000


def write_split_jsonl(task_rows: DataFrame, out: str, task: str) -> dict[str, str]:
    """``<task>_train`` with prompt/completion and ``<task>_test`` with prompt/gold."""
    paths = {}
    for split, label in (("train", "completion"), ("test", "gold")):
        paths[split] = f"{out}/{task}_{split}.jsonl"
        (task_rows.where(F.col("split") == split).select("prompt", label)
         .write.mode("overwrite").json(paths[split]))
    return paths


def write_eval_report(summary: DataFrame, preds: DataFrame, path: str) -> None:
    """The report rows as JSON documents and the predictions as a table beside them.

    Predictions grow with the test set, so they are not folded into one document; a file holds
    ``REPORT_ROWS`` rows of a run at most, however many tasks made them.
    """
    summary.write.mode("overwrite").json(f"{path}/summary")
    (preds.repartition("run_id", F.floor(F.col("seq") / REPORT_ROWS))
     .write.mode("overwrite").partitionBy("run_id").option("maxRecordsPerFile", REPORT_ROWS)
     .parquet(f"{path}/predictions"))


def nested_reports(summary: DataFrame, preds: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One document a run: its report and, in ``predictions``, all of them by ``seq``.

    A document is one row, so a run of more than ``most`` predictions is an error; keep those
    as a table (``write_eval_report``). Chunks are put together first, then the runs. Write with
    ``ignoreNullFields`` off to keep the keys of missing predictions.
    """
    large = preds.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    found = large.orderBy("run_id").first()
    if found:
        raise ValueError(f"run {found.run_id} has {found.n} predictions, over {most}")
    row = F.struct("seq", "gold", "pred", "raw")
    chunks = (preds.groupBy("run_id", F.floor(F.col("seq") / CHUNK_ROWS).alias("chunk"))
              .agg(F.array_sort(F.collect_list(row)).alias("rows")))
    whole = chunks.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "rows"))).alias("chunks"))
    listed = F.transform(F.flatten("chunks.rows"),
                         lambda r: F.struct(r["gold"].alias("gold"), r["pred"].alias("pred"),
                                            r["raw"].alias("raw")))
    none = F.array().cast("array<struct<gold:string,pred:string,raw:string>>")
    return (summary.join(whole.select("run_id", listed.alias("predictions")), "run_id",
                         "left")
            .withColumn("predictions", F.coalesce("predictions", none)))


def write_batches(df: DataFrame, path: str, pad_id: int | None = None,
                  per_file: int = FILE_BATCHES) -> None:
    """Batches in batch order, members in place; a file holds ``per_file`` batches.

    The batch number is dense, so it tells the file without sampling the rows for ranges: each
    range is a folder that names its first batch and the one after its last. With ``pad_id``
    the rows are padded to the width of their batch where they are written, after they have
    been moved. Set ``per_file`` so that a file is some hundred MB.
    """
    order = _order(df)
    first = F.floor(F.col(order) / per_file) * per_file
    placed = (df.withColumn("first_batch", first).withColumn("next_batch", first + per_file)
              .repartition("first_batch")
              .sortWithinPartitions("first_batch", "next_batch", order, "pos_in_batch"))
    if pad_id is not None:
        placed = pad_right(placed, pad_id)
    placed.write.mode("overwrite").partitionBy("first_batch", "next_batch").parquet(path)


def read_batches(spark: SparkSession, path: str, start: int = 0,
                 stop: int | None = None) -> DataFrame:
    """Batches ``start`` to ``stop`` (not itself) of a written set; other files stay closed.

    Row order within a file is that of the batches; sort by batch and ``pos_in_batch`` where
    it matters across files.
    """
    rows = spark.read.parquet(path)
    order = _order(rows)
    rows = rows.where((F.col("next_batch") > start) & (F.col(order) >= start))
    if stop is not None:
        rows = rows.where((F.col("first_batch") < stop) & (F.col(order) < stop))
    return rows.drop("first_batch", "next_batch")


def _order(df: DataFrame) -> str:
    return "batch_order" if "batch_order" in df.columns else "batch_id"
