"""Exact global ranks, prefix aggregates and "first n" without a one-task sort.

Rows are cut into small order-preserving groups (a shard of the order key, or
the leading digits of a hash). Only the group counts are summed globally; the
rows are ordered inside their group. No group can hold more than ``shard_rows``
rows of a unique key, however skewed the rest of the data is. Keys with huge
gaps would make many small groups; ``dense_seq`` closes the gaps, and numbers
rows by any other sortable key. Groups of a hash stay below that up to
``shard_rows * 16 ** 4`` rows.

The inputs are read more than once, mostly their key columns only. Inputs that
are costly to compute should be stored first (``session.stage_table``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.session import stage_table

SHARD_ROWS = 1 << 18
_FAN = 4096
_HASH_DIGITS = 4
# Keys of a larger range than so many times the rows are numbered anew.
_MOST_GAPS = 16


# Group columns are never null, so neither joins nor filters have to test them.
_NO_SHARD = -(1 << 62)


def with_shard(df: DataFrame, seq: str = "seq", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``_block`` and ``_shard``: coarse and fine groups of a unique integer key."""
    key = F.col(seq).cast("bigint")
    shard = F.floor(key / F.lit(shard_rows)) if shard_rows & (shard_rows - 1) \
        else F.shiftright(key, shard_rows.bit_length() - 1)
    return (df.withColumn("_shard", F.coalesce(shard, F.lit(_NO_SHARD)).cast("bigint"))
            .withColumn("_block", F.shiftright(F.col("_shard"), _FAN.bit_length() - 1)))


def with_hash(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """Add ``_hash`` (md5 of ``seed:key``) and ``_bin``, its first four digits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return (df.withColumn("_hash", F.coalesce(digest, F.lit("")))
            .withColumn("_bin", F.substring("_hash", 1, _HASH_DIGITS)))


def running_offsets(counts: DataFrame, levels: list[str], value: str = "_n",
                    out: str = "_offset") -> DataFrame:
    """Exclusive running total of ``value`` over ``levels``, listed coarse to fine.

    The total is nested: each window partition holds the children of one parent,
    and the outermost window holds the coarsest level only.
    """
    *outer, last = levels
    window = (Window.partitionBy(*outer) if outer else Window).orderBy(last)
    window = window.rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))
    if not outer:
        return within
    parents = counts.groupBy(*outer).agg(F.sum(value).alias(value))
    base = f"_base{len(outer)}"
    above = running_offsets(parents, outer, value, base).select(*outer, base)
    return within.join(above, outer).withColumn(out, F.col(out) + F.col(base)).drop(base)


def _group_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """Rows per group. The explicit null checks are the ones the joins would infer; stating
    them keeps every use of the table the same plan, so its shuffle is made once."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in levels])
    return df.where(present).groupBy(*levels).agg(F.count("*").alias("_n"))


def dist_rank(df: DataFrame, levels: list[str], order: list[str],
              out: str = "rank") -> DataFrame:
    """Add the 0-based global rank by ``(levels, order)``.

    ``levels`` must sort the same way as the wanted order and be non-null. The
    join with the offsets and the row number share one partitioning.
    """
    counts = _group_counts(df, levels)
    offsets = running_offsets(counts, levels).select(*levels, "_offset")
    within = F.row_number().over(Window.partitionBy(*levels).orderBy(*order))
    return (df.join(offsets, levels)
            .withColumn(out, (F.col("_offset") + within - 1).cast("bigint"))
            .drop("_offset"))


def dense_seq(df: DataFrame, order: list[str], out: str = "seq") -> DataFrame:
    """Number rows 0, 1, 2 … by any unique sort key, whatever its type and gaps.

    The rows are range-partitioned, sorted and staged once, with their place;
    the offsets of the ranges (one per partition) are added afterwards.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage_table(ranged.select("*", F.spark_partition_id().alias("_part"),
                                       F.monotonically_increasing_id().alias("_id")), "ranges")
    spans = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # one row per shuffle partition
    starts = F.broadcast(running_offsets(spans, ["_part"]).drop("_n"))
    return (placed.join(starts, "_part")
            .withColumn(out, F.col("_offset") + F.col("_id") - F.col("_first"))
            .drop("_part", "_id", "_first", "_offset"))


def is_dense(df: DataFrame, seq: str, shard_rows: int = SHARD_ROWS) -> bool:
    """Whether the shards of an integer key are few, or filled well enough to be worth it."""
    low, high, n = df.agg(F.min(seq), F.max(seq), F.count(seq)).first()
    span = int(high) - int(low) if n else 0
    return span <= _FAN * shard_rows or span <= _MOST_GAPS * n


def numbered(df: DataFrame, seq: str, out: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``out``, a key in the order of ``seq`` that makes few shards: ``seq`` itself, or the
    place of a row where ``seq`` has wide gaps."""
    if is_dense(df, seq, shard_rows):
        return df.withColumn(out, F.col(seq))
    return dense_seq(df, [seq], out)


def rank_by_seq(df: DataFrame, seq: str = "seq", out: str = "rank",
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    if not is_dense(df, seq, shard_rows):
        return dense_seq(df, [seq], out)
    ranked = dist_rank(with_shard(df, seq, shard_rows), ["_block", "_shard"], [seq], out)
    return ranked.drop("_block", "_shard")


def rank_by_hash(df: DataFrame, key: str, seed: int | str, out: str = "rank") -> DataFrame:
    """Rank in a random but reproducible order: md5 of ``seed:key``, then the key."""
    return dist_rank(with_hash(df, key, seed), ["_bin"], ["_hash", key], out).drop("_bin", "_hash")


def _cut_row(df: DataFrame, levels: list[str], order: list[str],
             want: Callable[[Column], Column]) -> DataFrame:
    """One row with the n-th ``order`` struct and the row count, or none for n = 0."""
    counts = _group_counts(df, levels)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_t")).scalar()
    # subqueries become columns at once: each further mention would be planned anew
    edge = (running_offsets(counts, levels).withColumn("_total", total)
            .withColumn("_want", F.least(want(F.col("_total")), F.col("_total")))
            .where("_offset < _want AND _want <= _offset + _n")
            .select(*levels, (F.col("_want") - F.col("_offset")).alias("_need"), "_total"))
    at = F.row_number().over(Window.partitionBy(*levels).orderBy(*order))
    # the edge is a single group, so a single row is broadcast
    return (df.select(*levels, *order).join(F.broadcast(edge), levels)
            .withColumn("_at", at).where(F.col("_at") == F.col("_need"))
            .select(F.struct(F.struct(*order).alias("at"), F.col("_total").alias("total"))
                    .alias("_cut")))


def _first_n(df: DataFrame, levels: list[str], order: list[str],
             want: Callable[[Column], Column], out: str, total: str | None) -> DataFrame:
    """Flag the first n rows by ``order``, which ``levels`` only coarsen.

    Two passes over the key columns find the n-th row; the full rows are only
    compared with it, so they are never shuffled. ``total`` names a column for
    the row count.
    """
    cut = _cut_row(df.select(*levels, *order), levels, order, want).scalar()
    flagged = df.withColumn("_cut", cut).withColumn(
        out, F.coalesce(F.struct(*order) <= F.col("_cut.at"), F.lit(False)))
    return (flagged.withColumn(total, F.col("_cut.total")) if total else flagged).drop("_cut")


def first_n_by_seq(df: DataFrame, want: Callable[[Column], Column], seq: str = "seq",
                   out: str = "in_first", shard_rows: int = SHARD_ROWS) -> DataFrame:
    if not is_dense(df, seq, shard_rows):
        ranked = dense_seq(df, [seq], "_place")
        wanted = want(F.lit(ranked.count()))
        return ranked.withColumn(out, F.col("_place") < wanted).drop("_place")
    flagged = _first_n(with_shard(df, seq, shard_rows), ["_block", "_shard"], [seq], want, out, None)
    return flagged.drop("_block", "_shard")


def first_n_by_hash(df: DataFrame, key: str, seed: int | str,
                    want: Callable[[Column], Column], out: str = "in_first",
                    total: str | None = None) -> DataFrame:
    flagged = _first_n(with_hash(df, key, seed), ["_bin"], ["_hash", key], want, out, total)
    return flagged.drop("_bin", "_hash")


def prefix_aggregates(df: DataFrame, part: list[str], order: str,
                      aggs: dict[str, tuple[str, Column]], inclusive: bool = True,
                      shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` per ``part`` in the order of a unique integer key.

    ``aggs`` maps an output column to (kind, value). One huge ``part`` is spread
    over its shards: shard totals are combined first, then each shard is scanned
    on its own. ``inclusive=False`` looks at earlier rows only (null before the
    first).
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    cut = with_shard(df, order, shard_rows).drop("_block")
    for name, (_, value) in aggs.items():
        cut = cut.withColumn(f"_v_{name}", value)
    keys = [*part, "_shard"]
    totals = cut.groupBy(*keys).agg(*[fold[kind](f"_v_{name}").alias(f"_t_{name}")
                                      for name, (kind, _) in aggs.items()])
    earlier = (Window.partitionBy(*part).orderBy("_shard")
               .rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(*keys, *[fold[kind](f"_t_{name}").over(earlier).alias(f"_b_{name}")
                                    for name, (kind, _) in aggs.items()])
    here = (Window.partitionBy(*keys).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    # a null part is a part of its own
    same = [F.col(p).eqNullSafe(F.col(f"_p_{i}")) for i, p in enumerate(part)]
    before = before.withColumnsRenamed({p: f"_p_{i}" for i, p in enumerate(part)} | {"_shard": "_at"})
    out = cut.join(before, reduce(lambda a, b: a & b, same, F.col("_shard") == F.col("_at")))
    for name, (kind, _) in aggs.items():
        local = fold[kind](f"_v_{name}").over(here)
        prior = F.col(f"_b_{name}")
        if kind == "sum":
            both = F.coalesce(local + prior, local, prior)
        elif kind == "min":
            both = F.least(local, prior)
        else:
            both = F.greatest(local, prior)
        out = out.withColumn(name, both)
    return out.drop("_shard", "_at", *[f"_p_{i}" for i in range(len(part))],
                    *[f"_{p}_{name}" for name in aggs for p in ("v", "b")])
