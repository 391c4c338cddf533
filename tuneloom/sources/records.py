"""Instruction records and evaluation rows from files and tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tuneloom.operators.normalize import drop_unusable, normalize_records
from tuneloom.operators.ranks import dense_seq, is_dense, running_offsets
from tuneloom.operators.splits import head_cap
from tuneloom.schemas import EVAL_ROW, SFT_RAW
from tuneloom.session import stage_table


# A table of at most this many files or splits is small enough to broadcast.
_MAX_BROADCAST_SPANS = 500_000


def _start_of(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_offset``, the rows before the row's file or split, and the other span columns.

    Spans are counted before they are broadcast; more of them are joined by key.
    """
    spans = stage_table(spans, "spans")
    starts = running_offsets(spans, keys).drop("_n")
    if spans.count() <= _MAX_BROADCAST_SPANS:
        starts = F.broadcast(starts)
    return rows.join(starts, keys)


def with_parquet_seq(df: DataFrame, out: str = "seq") -> DataFrame:
    """Number the rows of a Parquet scan densely, by file name and row position.

    The format knows the position of a row in its file, so only the files have
    to be counted, which reads no column.
    """
    place = F.col("_metadata.file_path").alias("_file")
    rows = df.select("*", place, F.col("_metadata.row_index").alias("_row"))
    spans = df.select(place).groupBy("_file").agg(F.count("*").alias("_n"))
    return (_start_of(rows, spans, ["_file"])
            .withColumn(out, F.col("_offset") + F.col("_row"))
            .drop("_file", "_row", "_offset"))


def with_file_seq(df: DataFrame, out: str = "seq") -> DataFrame:
    """Number the rows of a text file scan densely, in file name and line order.

    Row ids of a scan follow its task order, not the file order, and task
    layouts may differ between two scans. So the parsed rows are staged once
    with their file, split and id; a split is the group in which rows are ordered.
    """
    located = stage_table(
        df.select("*", F.col("_metadata.file_path").alias("_file"),
                  F.col("_metadata.file_block_start").alias("_split"),
                  F.monotonically_increasing_id().alias("_id")), "records")
    keys = ["_file", "_split"]
    # the rows of one split are consecutive in one task
    spans = located.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    return (_start_of(located, spans, keys)
            .withColumn(out, F.col("_offset") + F.col("_id") - F.col("_first"))
            .drop(*keys, "_id", "_first", "_offset"))


def read_sft_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Loose instruction JSON lines with ``seq`` and ``record_id``; a bad line is an error.

    Values are read as strings; numbers, flags and objects keep their JSON text.
    """
    raw = spark.read.schema(SFT_RAW).option("mode", "FAILFAST").json(path)
    return with_file_seq(raw).withColumn("record_id", F.col("seq"))


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``{prompt, gold}`` lines with ``seq``; a blank or bad line or an empty file is an error.

    Blank lines are counted on the pass that parses and stages the rows.
    """
    seen = Observation()
    blank = F.col("value").rlike(r"^\s*$")
    lines = spark.read.text(path).observe(seen, F.count("*").alias("lines"),
                                          F.count_if(blank).alias("blank"))
    row = F.from_json("value", EVAL_ROW, {"mode": "FAILFAST"})
    numbered = with_file_seq(lines.where(~blank).withColumn("_row", row)
                             .select("_row.*", "_metadata"))
    counts = seen.get
    if counts["lines"] == 0:
        raise ValueError(f"{path} is empty")
    if counts["blank"]:
        raise ValueError(f"{path} has blank lines")
    return numbered.drop("_metadata")


def load_records(spark: SparkSession, source: str, split: str = "train",
                 max_examples: int | None = None, chat: bool = False,
                 seq: str | None = None, kind: str | None = None) -> DataFrame:
    """Normalised, usable, capped records from JSON lines, Parquet or a table.

    ``kind`` is ``jsonl``, ``parquet`` or ``table``; without it the name tells: JSON by its
    ending, packed or not, other paths are Parquet and plain names tables. A table with a
    ``split`` column is reduced to ``split``. ``seq`` names its unique order column; one that
    is no integer, or has wide gaps, is numbered. Files are numbered by name and line.
    """
    if kind is None:
        kind = "jsonl" if re.search(r"\.jsonl?(\.(gz|bz2|zst|xz))?$", source) else \
            "parquet" if source.endswith(".parquet") or "/" in source else "table"
    if kind not in ("jsonl", "parquet", "table"):
        raise ValueError(f"unknown kind {kind}")
    if kind == "jsonl":
        raw = read_sft_jsonl(spark, source)
    else:
        if kind == "parquet":
            raw = spark.read.parquet(source)
            if seq is None:
                raw = with_parquet_seq(raw)
        else:
            raw = spark.table(source)
            if seq is None:
                raise ValueError("name the unique order column of a table with seq=")
        if "split" in raw.columns:
            raw = raw.where(F.col("split") == split)
        if seq is not None:
            raw = (raw.withColumn("seq", F.col(seq).cast("bigint"))
                   if isinstance(raw.schema[seq].dataType, IntegralType) and is_dense(raw, seq)
                   else dense_seq(raw, [seq]))
        if "record_id" not in raw.columns:
            raw = raw.withColumn("record_id", F.col("seq"))
    return head_cap(drop_unusable(normalize_records(raw, chat)), max_examples)
