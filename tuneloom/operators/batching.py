"""Tokenised examples and their layout into plain, length-bucketed or packed batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneloom.constants import IGNORE_LABEL
from tuneloom.functions.tokens import (append_eos, fill_left, fill_right, mask_prompt, truncate)
from tuneloom.operators.lengths import analyze_lengths, length_histogram
from tuneloom.operators.normalize import prompt_text, rendered_text
from tuneloom.operators.packing import packed_blocks
from tuneloom.operators.ranks import (SHARD_ROWS, dist_rank, numbered, rank_by_hash,
                                      rank_by_seq, with_shard)
from tuneloom.session import stage_table


def tokenize_records(df: DataFrame, tok, max_len: int) -> DataFrame:
    """Each record once: ``input_ids``, masked ``labels``, ``prompt_len`` and ``length``.

    Plain text gets no end marker and no mask. Arrays are stored unpadded.
    Prompt counts of the length filter are used if they are there.
    """
    is_text = F.col("kind") == "text"
    prompt_len = (F.col("prompt_tokens") if "prompt_tokens" in df.columns
                  else F.when(is_text, 0).otherwise(tok.count(prompt_text())))
    ids = F.when(is_text, F.col("_whole")).otherwise(append_eos(F.col("_whole"), tok.eos_id))
    return (df.withColumns({"_whole": tok.ids(rendered_text()), "prompt_len": prompt_len})
            .withColumn("input_ids", truncate(ids, max_len))
            .withColumns({"labels": mask_prompt(F.col("input_ids"), F.col("prompt_len")),
                          "length": F.size("input_ids")})
            .select("record_id", "seq", "input_ids", "labels", "prompt_len", "length"))


def _chunk(df: DataFrame, rank: str, batch_size: int) -> DataFrame:
    return (df.withColumn("batch_id", F.floor(F.col(rank) / batch_size).cast("bigint"))
            .withColumn("pos_in_batch", (F.col(rank) % batch_size).cast("int"))
            .drop(rank))


def _on_rows(df: DataFrame, layout: DataFrame, key: str = "seq") -> DataFrame:
    """Bring a layout of ``(key, length)`` to the rows: token arrays are moved by this join only."""
    return df.join(layout.drop("length"), key)


def _with_width(df: DataFrame) -> DataFrame:
    """Longest member per batch; a window group is one batch."""
    return df.withColumn("width", F.max("length").over(Window.partitionBy("batch_id")))


def plain_batches(df: DataFrame, batch_size: int = 4, shuffle: bool = False, seed: int = 0,
                  key: str = "seq", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Chunks in record order, or in a seeded random order, padded to the batch maximum."""
    narrow = df.select(key, "length")
    ranked = (rank_by_hash(narrow, key, seed, "_rank") if shuffle
              else rank_by_seq(narrow, key, "_rank", shard_rows))
    return _on_rows(df, _with_width(_chunk(ranked, "_rank", batch_size)), key)


def _batch_widths(df: DataFrame, batch_size: int) -> DataFrame:
    """Per length: ``_hi``, where its rank range ends, and the width of the batch at that end.

    That batch is as wide as the row at its last rank, i.e. the first length
    whose range ends beyond it. The lookup runs backwards over the histogram.
    """
    hist = length_histogram(df)
    n = F.max("hi").over(Window.partitionBy())
    last = F.least((F.floor((F.col("hi") - 1) / batch_size) + 1) * batch_size, n) - 1
    probes = hist.select(last.alias("at"), F.lit(1).alias("probe"), "length", "hi")
    ends = hist.select(F.col("hi").alias("at"), F.lit(0).alias("probe"), "length", "hi")
    beyond = (Window.orderBy(F.desc("at"), F.desc("probe"))
              .rowsBetween(Window.unboundedPreceding, -1))
    found = F.last(F.when(F.col("probe") == 0, F.col("length")), ignorenulls=True).over(beyond)
    return (probes.unionByName(ends).withColumn("_tail", found).where(F.col("probe") == 1)
            .select("length", F.col("hi").alias("_hi"), "_tail"))


def bucket_batches(df: DataFrame, batch_size: int = 4, shuffle: bool = False, seed: int = 0,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Chunks of the stable length order, so that each batch pads little.

    A batch is as wide as its last row. Inside the rank range of one length that
    is the length itself; only the batch that runs over the end of the range is
    wider. Both come from the histogram (at most ``max_len + 1`` rows), so the
    rows are shuffled once, for their rank.
    """
    narrow = numbered(df.select("seq", "length"), "seq", "_place", shard_rows)
    ranked = dist_rank(with_shard(narrow, "_place", shard_rows), ["length", "_block", "_shard"],
                       ["_place"], "_rank").drop("_block", "_shard", "_place")
    end = (F.floor(F.col("_rank") / batch_size) + 1) * batch_size
    sized = (ranked.join(_batch_widths(narrow, batch_size), "length")
             .withColumn("width", F.when(end <= F.col("_hi"), F.col("length"))
                         .otherwise(F.col("_tail")))
             .drop("_hi", "_tail"))
    batches = _chunk(sized, "_rank", batch_size)
    if shuffle:
        batches = shuffle_batches(stage_table(batches, "layout"), seed)
    return _on_rows(df, batches)


def shuffle_batches(df: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``batch_order``, a seeded permutation of the batches; members stay together.

    Batches are numbered before the shuffle, so a short last batch cannot shift
    the others. Only the batch numbers are permuted; their first members stand for them.
    """
    ids = df.where(F.col("pos_in_batch") == 0).select("batch_id")
    return df.join(rank_by_hash(ids, "batch_id", seed, "batch_order"), "batch_id")


def pad_right(df: DataFrame, pad_id: int) -> DataFrame:
    """Equal-width rows per batch: pad ids, ignored labels, attention 1/0, positions 0."""
    if "width" not in df.columns:
        df = _with_width(df)
    width, n = F.col("width"), F.size("input_ids")
    padded = (df.withColumn("attention_mask",
                            F.concat(F.array_repeat(F.lit(1), n),
                                     F.array_repeat(F.lit(0), width - n)))
              .withColumn("input_ids", fill_right(F.col("input_ids"), pad_id, width))
              .withColumn("labels", fill_right(F.col("labels"), IGNORE_LABEL, width)))
    if "position_ids" in df.columns:
        padded = padded.withColumn("position_ids", fill_right(F.col("position_ids"), 0, width))
    return padded


def pad_left(df: DataFrame, pad_id: int, max_len: int) -> DataFrame:
    """Generation batches: prompts cut at ``max_len`` and padded on the left."""
    cut = df.withColumn("input_ids", truncate(F.col("input_ids"), max_len))
    cut = _with_width(cut.withColumn("length", F.size("input_ids")))
    width, n = F.col("width"), F.size("input_ids")
    return (cut.withColumn("attention_mask",
                           F.concat(F.array_repeat(F.lit(0), width - n),
                                    F.array_repeat(F.lit(1), n)))
            .withColumn("input_ids", fill_left(F.col("input_ids"), pad_id, width)))


def adaptive_batches(df: DataFrame, batch_size: int = 4, max_len: int = 1024,
                     strategy: str = "auto", shuffle: bool = False, seed: int = 0,
                     shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, dict]:
    """Lay out tokenised records the cheapest way; returns (batches, info).

    ``auto`` reads the one analysis row and takes its choice. ``pack`` and
    ``bucket`` force that layout, any other name pads in record order.
    """
    if strategy == "auto":
        info = analyze_lengths(df, max_len, batch_size).first().asDict()
    else:
        info = {"strategy": strategy, "reason": "user-forced"}
    if info["strategy"] == "pack":
        blocks = packed_blocks(df, max_len, shard_rows=shard_rows)
        return block_batches(blocks, batch_size, shuffle, seed), info
    if info["strategy"] == "bucket":
        return bucket_batches(df, batch_size, shuffle, seed, shard_rows), info
    return plain_batches(df, batch_size, shuffle, seed, shard_rows=shard_rows), info


def block_batches(blocks: DataFrame, batch_size: int = 4, shuffle: bool = False,
                  seed: int = 0) -> DataFrame:
    """Batches of packed blocks; block numbers are already dense.

    Shuffled blocks are written once, so that they are not packed again for their order.
    """
    sized = blocks.withColumn("length", F.size("input_ids"))
    if shuffle:
        return plain_batches(stage_table(sized, "blocks"), batch_size, True, seed, "block_id")
    return _with_width(_chunk(sized.withColumn("_rank", F.col("block_id")), "_rank", batch_size))


def padded_tokens(df: DataFrame, width: Column | None = None) -> DataFrame:
    """Tokens pushed through a model by a batched table, and the useful part of them."""
    return df.agg(F.sum(F.col("width") if width is None else width).cast("bigint")
                  .alias("padded_tokens"),
                  F.sum("length").cast("bigint").alias("useful_tokens"))
