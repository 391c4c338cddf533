"""What several corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.session import job_stages, stage_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column, folds: int) -> Column:
    """True for keys whose crc32 as text leaves no remainder; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(folds) == 0


def word_count(text: Column) -> Column:
    """Words of a text, null being an empty one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_key(text: Column) -> Column:
    """Stands for the whole text in joins and groups; all null texts are equal."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def block_of(blocks: Column | int, *keys: str) -> Column:
    """A block in 0 … blocks-1 that depends on the keys alone, not on where a row lies."""
    return F.pmod(F.xxhash64(*keys), F.lit(blocks) if isinstance(blocks, int) else blocks)


def row_key() -> Column:
    """Stands for a document: its id and its whole text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                       text_key(F.col("text")))


def named(column: str) -> Column:
    """A column by its plain name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*map(named, docs.columns))


def row_hash(docs: DataFrame) -> Column:
    """Tells rows apart that are equal in id and text but not in other columns."""
    return F.xxhash64(F.to_json(whole_row(docs)))


def staged(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written to the shared folder; what is staged on the way to it is dropped then."""
    path = stage_path(spark, name)
    with job_stages(spark):
        made = build()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)
