"""Live views of training logs and of scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tuneloom.operators.ranks import SHARD_ROWS, prefix_aggregates
from tuneloom.operators.runs import seconds_between, usable_loss
from tuneloom.operators.scoring import is_correct
from tuneloom.streaming.sinks import write_per_batch
from tuneloom.streaming.versions import keep_versions, read_versions, write_version


def best_checkpoint_view(metrics: DataFrame) -> DataFrame:
    """Best validation loss per run so far; works on a stream and on a table."""
    val = metrics.where((F.col("kind") == "val") & usable_loss())
    return (val.groupBy("run_id").agg(F.min(F.struct("loss", "iter")).alias("_best"))
            .select("run_id", F.col("_best.loss").alias("best_val"),
                    F.col("_best.iter").alias("best_iter")))


def stream_best_checkpoint(metrics: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return keep_versions(best_checkpoint_view(metrics), out, checkpoint, ["run_id"])


def progress_view(metrics: DataFrame) -> DataFrame:
    """Mean loss, tokens and time span of each (run, epoch) so far."""
    train = metrics.where(F.col("kind") == "train")
    return train.groupBy("run_id", "epoch").agg(
        F.avg("loss").alias("mean_loss"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn(
        "seconds", seconds_between(F.col("last_ts"), F.col("first_ts"))
    ).withColumn("tokens_per_s", F.when(F.col("seconds") > 0,
                                        F.col("tokens") / F.col("seconds"))
                 .otherwise(F.lit(0.0))).drop("first_ts", "last_ts")


def stream_progress(metrics: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return keep_versions(progress_view(metrics), out, checkpoint, ["run_id", "epoch"])


def accuracy_view(preds: DataFrame) -> DataFrame:
    return preds.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(is_correct()).alias("correct")).withColumn(
        "accuracy", F.col("correct") / F.col("n"))


def stream_running_accuracy(preds: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return keep_versions(accuracy_view(preds), out, checkpoint, ["run_id"])


def read_latest(spark, out: str, schema: StructType, keys: list[str]) -> DataFrame:
    """What a live view has reached."""
    return read_versions(spark, out, schema, keys)


def stream_new_best_events(metrics: DataFrame, out: str, checkpoint: str, state: str,
                           shard_rows: int = SHARD_ROWS) -> StreamingQuery:
    """Emit a validation row only when it beats everything its run has logged before.

    Rows are ordered by iteration inside a micro-batch. The best of earlier
    batches is a keyed table below ``state``, of which a batch writes the runs it
    has touched; a hot run is scanned shard by shard, not in one group. A row that
    arrives after a later iteration is still judged by value, and flagged.
    """
    spark = metrics.sparkSession
    columns = StructType([StructField("run_id", LongType()), StructField("best_val", DoubleType()),
                          StructField("max_iter", LongType())])

    def events(rows: DataFrame, batch_id: int) -> DataFrame:
        val = rows.where(F.col("kind") == "val").select("run_id", "iter", "loss")
        usable = F.when(usable_loss(), F.col("loss"))
        # what was before this batch, also when the batch is retried
        seen = read_versions(spark, state, columns, ["run_id"], before=batch_id).join(
            val.select("run_id").distinct(), "run_id", "left_semi")
        here = prefix_aggregates(val, ["run_id"], "iter", {"_before": ("min", usable)},
                                 inclusive=False, shard_rows=shard_rows)
        bar = F.least(F.col("_before"), F.col("best_val"))
        found = (here.join(seen, "run_id", "left")
                 .where(usable_loss() & (bar.isNull() | (F.col("loss") < bar)))
                 .select("run_id", "iter", F.col("loss").alias("val_loss"),
                         F.coalesce(F.col("iter") < F.col("max_iter"), F.lit(False))
                         .alias("late")))
        now = val.select("run_id", usable.alias("best_val"), F.col("iter").alias("max_iter"))
        touched = seen.unionByName(now).groupBy("run_id").agg(
            F.min("best_val").alias("best_val"), F.max("max_iter").alias("max_iter"))
        write_version(touched, state, batch_id, ["run_id"])
        return found

    return write_per_batch(metrics, out, checkpoint, transform=events)


