"""Token lengths, the length filter, and the cost of padding, bucketing and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tuneloom.constants import PACK_MAX_P90_SHARE, PACK_MIN_GAIN
from tuneloom.operators.normalize import prompt_text, rendered_text


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is computed once per row.

    A filter on a plain column would be pushed below it, repeating its
    expression at each use; it is not pushed below a generator.
    """
    row = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(row))


def with_lengths(df: DataFrame, tok, max_len: int) -> DataFrame:
    """Add ``n_tokens`` (whole, no end marker) and ``length`` (end marker added, cut).

    The filter has already counted plain texts; its count is used if it is there.
    """
    n_tokens = tok.count(rendered_text())
    if "completion_tokens" in df.columns:
        n_tokens = F.when(F.col("kind") == "text", F.col("completion_tokens")).otherwise(n_tokens)
    return df.withColumn("n_tokens", n_tokens).selectExpr(
        "*", f"least(n_tokens + CASE WHEN kind = 'text' THEN 0 ELSE 1 END, {max_len}) AS length")


def filter_for_training(df: DataFrame, tok, max_len: int, min_completion_tokens: int = 4,
                        enabled: bool = True) -> DataFrame:
    """Add token counts and ``drop_reason``; kept rows have a null reason.

    The end marker is not counted, so a pair of exactly ``max_len`` tokens is
    kept and loses its marker to truncation (``eos_truncated``).
    """
    reason = f"""
        CASE WHEN kind = 'text' THEN CASE WHEN completion_tokens < 2 THEN 'too_short' END
             WHEN prompt_tokens >= {max_len - min_completion_tokens} THEN 'prompt_too_long'
             WHEN prompt_tokens + completion_tokens > {max_len} THEN 'over_length' END"""
    is_text = F.col("kind") == "text"
    counted = _once(df, prompt_tokens=F.when(is_text, 0).otherwise(tok.count(prompt_text())),
                    completion_tokens=tok.count(F.expr(
                        "CASE WHEN kind = 'text' THEN text ELSE completion END")))
    return counted.selectExpr(
        "*", f"{reason if enabled else 'CAST(NULL AS STRING)'} AS drop_reason").selectExpr("*", f"""
        drop_reason IS NULL AND kind <> 'text'
        AND prompt_tokens + completion_tokens >= {max_len} AS eos_truncated""")


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.col("drop_reason").isNull())


def filter_counts() -> list[Column]:
    """What ``filter_stats`` reports, for aggregates and observations."""
    reason = F.col("drop_reason")
    return [
        F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason == "prompt_too_long").alias("dropped_prompt_too_long"),
        # texts below two tokens share this counter
        F.count_if(reason.isin("over_length", "too_short")).alias("dropped_over_length"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("eos_truncated")).alias("eos_truncated"),
    ]


def filter_stats(df: DataFrame) -> DataFrame:
    return df.agg(*filter_counts())


def observe_filter(df: DataFrame, name: str = "filter") -> tuple[DataFrame, Observation]:
    """The same counts, collected while ``df`` is written instead of in a pass of their own."""
    observation = Observation(name)
    return df.observe(observation, *filter_counts()), observation


def count_tokens(df: DataFrame, tok) -> DataFrame:
    """Exact token count of the rendered records, untruncated, without end markers."""
    return df.agg(F.coalesce(F.sum(tok.count(rendered_text())).cast("bigint"), F.lit(0))
                  .alias("total_tokens"))


def packing_stats(df: DataFrame, max_len: int = 1024) -> DataFrame:
    """Padding waste against an estimate of the packed cost, from the ``length`` column."""
    sums = df.agg(F.count("*").alias("examples"),
                  F.coalesce(F.sum("length").cast("bigint"), F.lit(0)).alias("real_tokens"))
    sums = (sums.withColumn("naive_padded_tokens", F.col("examples") * max_len)
            .withColumn("packed_tokens",
                        (F.ceil(F.col("real_tokens") / max_len) * max_len).cast("bigint")))

    def waste(cost: str):
        return F.when(F.col(cost) > 0, 100 * (1 - F.col("real_tokens") / F.col(cost))) \
            .otherwise(F.lit(0.0))

    return (sums.withColumn("waste_naive_pct", waste("naive_padded_tokens"))
            .withColumn("waste_packed_pct", waste("packed_tokens"))
            .withColumn("speedup_vs_naive",
                        F.when(F.col("packed_tokens") > 0,
                               F.col("naive_padded_tokens") / F.col("packed_tokens"))
                        .otherwise(F.lit(1.0))))


def length_histogram(df: DataFrame) -> DataFrame:
    """Rows per length with running counts ``lo`` and ``hi``.

    Lengths are cut at ``max_len``, so this table has at most ``max_len + 1``
    rows and its one-partition window is bounded.
    """
    upto = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    return (df.groupBy("length").agg(F.count("*").alias("cnt"))
            .withColumn("hi", F.sum("cnt").over(upto))
            .withColumn("lo", F.col("hi") - F.col("cnt")))


def analyze_lengths(df: DataFrame, max_len: int = 1024, batch_size: int = 4) -> DataFrame:
    """One row: length profile, useful share under each layout, and the layout to use.

    The bucket cost is a closed form over the histogram: a batch costs its
    longest member times its size, and the longest member of batch k is the row
    of rank (k+1)*B-1.
    """
    size = F.lit(batch_size)
    hist = length_histogram(df).withColumn("n", F.sum("cnt").over(Window.partitionBy()))
    full = F.floor(F.col("hi") / size) - F.floor(F.col("lo") / size)
    p90_rank = F.least(F.col("n") - 1, (F.col("n") * F.lit(0.9)).cast("bigint"))
    row = hist.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("examples"),
        F.sum(F.col("length").cast("bigint") * F.col("cnt")).alias("real_tokens"),
        F.min(F.when(F.col("hi") > F.floor(F.col("n") / 2), F.col("length"))).alias("p50_len"),
        F.min(F.when(F.col("hi") > p90_rank, F.col("length"))).alias("p90_len"),
        F.max("length").alias("max_len_seen"),
        F.sum(F.col("length") * size * full).alias("_full"))
    n, real, longest = F.col("examples"), F.col("real_tokens"), F.col("max_len_seen")
    row = (row.withColumn("naive_tokens", n * longest)
           .withColumn("bucket_tokens", (F.col("_full") + longest * (n % size)).cast("bigint"))
           .withColumn("pack_tokens", (F.ceil(real / max_len) * max_len).cast("bigint")))

    def useful(cost: str):
        return F.when(F.col(cost) > 0, real / F.col(cost)).when(n > 0, F.lit(1.0))

    row = (row.withColumn("useful_naive", useful("naive_tokens"))
           .withColumn("useful_bucket", useful("bucket_tokens"))
           .withColumn("useful_pack", useful("pack_tokens"))
           .withColumn("pack_gain_over_bucket",
                       F.when(F.col("useful_bucket") > 0,
                              F.col("useful_pack") / F.col("useful_bucket"))
                       .when(n > 0, F.lit(1.0))))
    packs = ((F.col("pack_gain_over_bucket") > PACK_MIN_GAIN)
             & (F.col("p90_len") < max_len * PACK_MAX_P90_SHARE))
    reason = (F.when(n == 0, F.lit("empty dataset"))
              .when(packs, F.format_string(
                  "packing does %.1fx the useful work of bucketing (p50 %d, p90 %d of %d)",
                  F.col("pack_gain_over_bucket"), F.col("p50_len"), F.col("p90_len"),
                  F.lit(max_len)))
              .otherwise(F.format_string(
                  "bucketing already trims the padding (p50 %d, p90 %d)",
                  F.col("p50_len"), F.col("p90_len"))))
    return (row.withColumn("strategy", F.when(packs, "pack").otherwise("bucket"))
            .withColumn("reason", reason).drop("_full"))
