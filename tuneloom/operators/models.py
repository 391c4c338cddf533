"""Model names, sizes and context limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.constants import DEFAULT_PARAMS_B, MODEL_PRESETS, SIZE_HINTS
from tuneloom.functions.text import base_name


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_PRESETS, "alias string, hf string, params_b double")


def enrich_models(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``hf``, ``params_b`` and ``alias``: a preset, or a guess from the name.

    The preset table is a fixed handful of rows, so it is broadcast.
    """
    presets = preset_table(df.sparkSession).select(
        F.col("alias").alias("_alias"), F.col("hf").alias("_hf"),
        F.col("params_b").alias("_params"))
    lower = F.lower(name)
    # first hint in order, so the chain is built from the last one outwards
    guess = reduce(lambda rest, hint: F.when(F.contains(lower, F.lit(hint[0])),
                                             F.lit(hint[1])).otherwise(rest),
                   reversed(SIZE_HINTS), F.lit(DEFAULT_PARAMS_B))
    return (df.join(F.broadcast(presets), F.col(name) == F.col("_alias"), "left")
            .withColumn("hf", F.coalesce("_hf", F.col(name)))
            .withColumn("params_b", F.coalesce("_params", guess))
            .withColumn("alias", F.coalesce("_alias", base_name(name)))
            .drop("_alias", "_hf", "_params"))


def clamp_context(df: DataFrame, model_configs: DataFrame, model: str = "model",
                  requested: str = "requested_len") -> DataFrame:
    """Lower the requested context to the model's limit; unknown or 0 leaves it."""
    limits = model_configs.select(
        F.col(model), F.coalesce(F.nullif(F.col("max_position_embeddings"), F.lit(0)),
                                 F.nullif(F.col("n_positions"), F.lit(0))).alias("_limit"))
    return (df.join(limits, model, "left")
            .withColumn("context_len", F.least(F.col(requested), F.col("_limit")))
            .drop("_limit"))
