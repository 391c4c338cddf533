"""Training plans and training-log analysis.

A log row is ``(run_id, epoch, iter, kind, loss, tokens, ts)``; ``iter`` is
unique within a run and gives the logging order, ``kind`` is train or val.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.constants import HEALTHY_GAP, WATCH_GAP
from tuneloom.operators.ranks import SHARD_ROWS, prefix_aggregates, with_shard


def training_plan(df: DataFrame, batch_size: int, epochs: int, accum: int = 1,
                  n_val: str = "n_val") -> DataFrame:
    """Step counts from ``n_train`` and ``n_val`` columns, one row per input row.

    ``planned_steps`` rounds the last accumulation up, ``applied_steps`` counts
    the optimiser steps that really happen.
    """
    batches, n = F.col("batches"), F.col("n_train")
    iters = F.col("iters")
    return (df.withColumn("batches", F.ceil(n / batch_size).cast("bigint"))
            .withColumn("planned_steps", F.ceil(batches / accum).cast("bigint") * epochs)
            .withColumn("applied_steps", F.floor(batches / accum).cast("bigint") * epochs)
            .withColumn("iters", F.greatest(F.lit(1), batches * epochs).cast("bigint"))
            .withColumn("report_every", F.greatest(F.lit(1), F.floor(iters / 10)).cast("bigint"))
            .withColumn("eval_every", F.greatest(F.lit(1), F.floor(iters / 6)).cast("bigint"))
            .withColumn("val_batches", F.greatest(F.lit(1), F.least(F.col(n_val), F.lit(20)))
                        .cast("bigint")))


def split_sizes(split: DataFrame) -> DataFrame:
    """One row with ``n_train`` and ``n_val`` of a flagged split."""
    return split.agg(F.count_if("in_train").alias("n_train"), F.count_if("in_val").alias("n_val"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds with fractions, for timestamps with or without a zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1_000_000)


def _rate(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


def _train(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("kind") == "train")


def epoch_summary(metrics: DataFrame) -> DataFrame:
    """Mean loss, useful tokens and tokens per second of each (run, epoch)."""
    return (_train(metrics).groupBy("run_id", "epoch").agg(
        F.avg("loss").alias("mean_loss"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.count("*").alias("micro_batches"),
        seconds_between(F.max(F.col("ts")), F.min(F.col("ts"))).alias("seconds"))
        .withColumn("tokens_per_s", _rate(F.col("tokens"), F.col("seconds"))))


def running_training_metrics(metrics: DataFrame, accum: int = 4, every: int = 5,
                             shard_rows: int = SHARD_ROWS) -> DataFrame:
    """What the training loop prints: a row per ``every`` optimiser steps.

    Loss and throughput run within an epoch, the step number runs across the
    epochs of a run. A leftover accumulation at the end of an epoch is no step.
    """
    train = _train(metrics)
    running = prefix_aggregates(
        train, ["run_id", "epoch"], "iter",
        {"i": ("sum", F.lit(1).cast("bigint")), "loss_sum": ("sum", F.col("loss")),
         "seen_tokens": ("sum", F.col("tokens").cast("bigint"))}, shard_rows=shard_rows)
    # one row per (run, epoch)
    epochs = train.groupBy("run_id", "epoch").agg(
        F.floor(F.count("*") / accum).cast("bigint").alias("_steps"), F.min("ts").alias("_t0"))
    earlier = (Window.partitionBy("run_id").orderBy("epoch")
               .rowsBetween(Window.unboundedPreceding, -1))
    epochs = epochs.withColumn("_before", F.coalesce(F.sum("_steps").over(earlier), F.lit(0)))
    seconds = seconds_between(F.col("ts"), F.col("_t0"))
    steps = with_shard(running.where(F.col("i") % accum == 0), "iter", shard_rows)
    return (_to_shards(steps.drop("_block"), ["run_id", "epoch"], epochs)
            .withColumn("step", (F.col("_before") + F.floor(F.col("i") / accum)).cast("bigint"))
            .where(F.col("step") % every == 0)
            .select("run_id", "epoch", "step", "iter",
                    (F.col("loss_sum") / F.col("i")).alias("loss"), "seen_tokens",
                    _rate(F.col("seen_tokens"), seconds).alias("tokens_per_s")))


def usable_loss() -> Column:
    """Whether a validation loss can win: a number below infinity."""
    loss = F.col("loss")
    return F.coalesce(~F.isnan(loss) & (loss < F.lit(float("inf"))), F.lit(False))


def new_best_flag(metrics: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Flag validation rows that beat every earlier one of their run."""
    val = metrics.where(F.col("kind") == "val")
    usable = F.when(usable_loss(), F.col("loss"))
    flagged = prefix_aggregates(val, ["run_id"], "iter", {"best_before": ("min", usable)},
                                inclusive=False, shard_rows=shard_rows)
    beats = F.col("best_before").isNull() | (F.col("loss") < F.col("best_before"))
    return flagged.withColumn("is_best", usable_loss() & beats)


def best_checkpoint(metrics: DataFrame) -> DataFrame:
    """Lowest validation loss per run, the earliest on ties; no usable one gives iter -1."""
    candidate = F.when((F.col("kind") == "val") & usable_loss(), F.struct("loss", "iter"))
    return (metrics.groupBy("run_id").agg(
        F.min(candidate).alias("_best"), F.count_if(F.col("kind") == "val").alias("n_val_rows"))
        .select("run_id", "n_val_rows",
                F.coalesce(F.col("_best.loss"), F.lit(float("inf"))).alias("best_val"),
                F.coalesce(F.col("_best.iter"), F.lit(-1)).cast("bigint").alias("best_iter")))


def _to_shards(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """Join ``found``, a row per key, to rows that are spread by key and shard.

    It goes to the distinct shards first, so a long run is met by its shards, not as one key.
    """
    spread = [*keys, "_shard"]
    return rows.join(rows.select(*spread).distinct().join(found, keys), spread)


def overfit_verdict(metrics: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Gap between the best validation loss and the train loss nearest to it.

    Runs without validation rows get no verdict. The nearest row is found per shard of a run,
    then among its shards.
    """
    best = best_checkpoint(metrics).where(F.col("n_val_rows") > 0)
    logged = with_shard(_train(metrics).select("run_id", "iter", "loss"), "iter", shard_rows)
    logged = _to_shards(logged.drop("_block"), ["run_id"], best.select("run_id", "best_iter"))
    near = F.struct(F.abs(F.col("iter") - F.col("best_iter")).alias("far"), "iter", "loss")
    at_best = (logged.groupBy("run_id", "_shard").agg(F.min(near).alias("_near"))
               .groupBy("run_id").agg(F.min("_near")["loss"].alias("train_loss")))
    gap = F.col("gap")
    return (best.join(at_best, "run_id", "left")
            .withColumn("train_loss", F.coalesce("train_loss", F.lit(float("nan"))))
            .withColumn("gap", F.col("best_val") - F.col("train_loss"))
            .withColumn("verdict", F.when(gap < HEALTHY_GAP, "healthy")
                        .when(gap < WATCH_GAP, "watch").otherwise("OVERFIT RISK"))
            .select("run_id", "best_iter", "best_val", "train_loss", "gap", "verdict"))


def resume_point(checkpoints: DataFrame) -> DataFrame:
    """Epoch to continue at, per run: one after the highest saved, 0 without any.

    ``checkpoints`` is ``(run_id, name)``; a run without checkpoints has a null
    name. Epochs compare as numbers, so epoch-10 follows epoch-9.
    """
    epoch = F.when(F.col("name").startswith("epoch-"),
                   F.get(F.split("name", "-"), F.lit(1)).cast("int"))
    return checkpoints.groupBy("run_id").agg(
        F.coalesce(F.max(epoch) + 1, F.lit(0)).cast("bigint").alias("start_epoch"))


def speedup_vs_baseline(bench: DataFrame) -> DataFrame:
    """Rate of each configuration over the first one of its benchmark; 1 if that is 0."""
    first = bench.groupBy("bench").agg(F.min_by("tokens_per_s", "pos").alias("_base"))
    return (bench.join(first, "bench")
            .withColumn("speedup", F.when(F.col("_base") > 0,
                                          F.col("tokens_per_s") / F.col("_base"))
                        .otherwise(F.lit(1.0))).drop("_base"))
