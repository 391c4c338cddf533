"""Caps, samples, splits and shuffles with exact counts and reproducible choices.

"Random" means the order of md5(seed:key): the same rows are chosen however the
data is partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneloom.operators.ranks import (SHARD_ROWS, first_n_by_hash, first_n_by_seq, rank_by_hash)

_MAX_COPIES_PER_STEP = 1 << 10


def head_cap(df: DataFrame, max_examples: int | None, seq: str = "seq",
             shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The first ``max_examples`` rows in record order; 0 or None keeps all.

    Not a sort with a limit: that would send n wide rows of every partition to
    one task.
    """
    if not max_examples:
        return df
    if max_examples < 0:
        raise ValueError("max_examples must not be negative")
    flagged = first_n_by_seq(df, lambda total: F.lit(max_examples).cast("bigint"), seq,
                             "_take", shard_rows)
    return flagged.where("_take").drop("_take")


def sample_exact(df: DataFrame, n: int, seed: int = 0, key: str = "seq") -> DataFrame:
    """Exactly ``min(n, size)`` rows, uniform, without replacement."""
    if n < 0:
        raise ValueError("n must not be negative")
    flagged = first_n_by_hash(df, key, seed, lambda total: F.lit(n).cast("bigint"), "_take")
    return flagged.where("_take").drop("_take")


def train_val_split(df: DataFrame, fraction: float = 0.1, seed: int = 0,
                    key: str = "seq") -> DataFrame:
    """Add ``in_val`` and ``in_train``; validation is the first part of the shuffle.

    More than 10 rows give the fraction, fewer a fifth, always at least one row
    and never all. Below 2 rows both sides get everything.
    """
    def n_val(total):
        wanted = F.when(total > 10, (total * F.lit(fraction)).cast("bigint")) \
            .otherwise(F.floor(total / 5))
        return F.when(total < 2, total).otherwise(
            F.least(F.greatest(F.lit(1), wanted), total - 1)).cast("bigint")

    flagged = first_n_by_hash(df, key, seed, n_val, "in_val", total="_total")
    return (flagged.withColumn("in_train", ~F.col("in_val") | (F.col("_total") < 2))
            .drop("_total"))


def shuffle(df: DataFrame, seed: int = 0, key: str = "seq") -> DataFrame:
    """Add ``position``, the row's place in the seeded permutation."""
    return rank_by_hash(df, key, seed, "position")


def amplify(df: DataFrame, min_rows: int) -> DataFrame:
    """Repeat a small table by doubling until it has ``min_rows`` rows; adds ``copy``."""
    n = df.count()
    if n == 0:
        raise ValueError("cannot amplify an empty table")
    doublings = max(0, -(-min_rows // n) - 1).bit_length()
    copies = 1 << doublings
    step = min(copies, _MAX_COPIES_PER_STEP)
    out = df
    if copies > step:
        # the first step spreads the copies, the second multiplies them in place
        outer = F.sequence(F.lit(0).cast("bigint"), F.lit(copies // step - 1).cast("bigint"))
        out = out.withColumn("_outer", F.explode(outer)).repartition("_outer")
    else:
        out = out.withColumn("_outer", F.lit(0).cast("bigint"))
    inner = F.sequence(F.lit(0).cast("bigint"), F.lit(step - 1).cast("bigint"))
    return (out.withColumn("_inner", F.explode(inner))
            .withColumn("copy", F.col("_outer") * step + F.col("_inner"))
            .drop("_outer", "_inner"))
