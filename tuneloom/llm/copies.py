"""Near copies by the share of five-word shingles: one document of each group stays."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.common import staged, whole_row
from tuneloom.llm.overlap import near_classes
from tuneloom.session import stage_table

SHINGLE = 5
LEAST = Fraction(4, 5)


def without_copies(docs: DataFrame, width: int = SHINGLE, least: Fraction = LEAST) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of near copies.

    A group is what hangs together by similarities of ``least`` or more, found by the
    T-occurrence join (``llm/overlap.py``) over whole texts. The row with the smallest id stays,
    null ids being last; where that id repeats, the text of least hash. Rows that are equal in
    id and text stay or go together. Texts without words are near copies of nothing. An empty
    table gives an empty result.
    """
    gone = staged(docs.sparkSession, "gone", lambda: copies_of(docs, width, least))
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents but those whose ``row_mark`` is in ``gone``."""
    full = docs.select(whole_row(docs).alias("row"), row_mark().alias("h"))
    return full.join(gone, "h", "left_anti").select("row.*")


def row_mark() -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), "text")


def copies_of(docs: DataFrame, width: int = SHINGLE, least: Fraction = LEAST) -> DataFrame:
    """``h``, the ``row_mark`` of all documents that are not the first of their group."""
    found = near_classes(docs, width, least).where(F.col("root").isNotNull())
    found = stage_table(found.select("doc_id", "h", "root"), "near-classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = found.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    first = stage_table(first.where("rows > 1").select("root", F.col("first.h").alias("kept")),
                        "kept")
    return found.join(first, "root").where("h <> kept").select("h").distinct()
