"""Incremental preparation of records from a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tuneloom.operators.batching import tokenize_records
from tuneloom.operators.lengths import filter_for_training, kept
from tuneloom.operators.normalize import drop_unusable, normalize_records
from tuneloom.operators.ranks import dense_seq, running_offsets
from tuneloom.schemas import SFT_RAW
from tuneloom.session import stage_table
from tuneloom.streaming.sinks import batch_folder, write_per_batch
from tuneloom.streaming.versions import read_versions, write_version


def read_landing(spark: SparkSession, folder: str, files_per_trigger: int | None = None,
                 id_field: str = "record_id") -> DataFrame:
    """Instruction JSON lines as a stream. The source assigns ``record_id``."""
    schema = StructType([*SFT_RAW.fields, StructField(id_field, LongType())])
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (reader.json(folder).withColumnRenamed(id_field, "record_id")
            .withColumn("seq", F.col("record_id")))


def prepare_view(raw: DataFrame, tok, max_len: int, chat: bool = False) -> DataFrame:
    """Normalise, filter and tokenise; stateless, so it runs on streams and tables alike."""
    records = drop_unusable(normalize_records(raw, chat))
    return tokenize_records(kept(filter_for_training(records, tok, max_len)), tok, max_len)


def stream_prepare(raw: DataFrame, tok, max_len: int, out: str, checkpoint: str,
                   chat: bool = False) -> StreamingQuery:
    """Append prepared records to a Parquet table, each input file once."""
    return (prepare_view(raw, tok, max_len, chat).writeStream.format("parquet")
            .outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_landing_lines(spark: SparkSession, folder: str,
                       files_per_trigger: int | None = None) -> DataFrame:
    """The lines of a landing folder as a stream, each with where it stands."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"))


def stream_prepare_lines(lines: DataFrame, tok, max_len: int, out: str, rejects: str, ledger: str,
                         checkpoint: str, chat: bool = False,
                         id_field: str = "record_id") -> StreamingQuery:
    """Prepare instruction JSON lines as they land; a bad line does not stop the stream.

    Blank lines are skipped. Lines that are no JSON object go to ``rejects`` with file, line
    number and text. The others are numbered densely (``seq``) in file and line order, going on
    from batch to batch by a ledger; lines without an id of their own have that number as
    ``record_id``. Files have to be complete when they land. Every micro-batch rewrites its own
    folders when it is retried.
    """
    spark = lines.sparkSession
    broken = StructField("_broken", StringType())
    shape = StructType([*SFT_RAW.fields, StructField(id_field, LongType()), broken])
    total = StructType([StructField("name", StringType()), StructField("n", LongType())])

    def prepare(rows: DataFrame, batch_id: int) -> DataFrame:
        located = stage_table(rows.withColumn("_id", F.monotonically_increasing_id()), "lines")
        # the lines of a split are consecutive in one task
        spans = located.groupBy("file", "split").agg(F.count("*").alias("_n"),
                                                     F.min("_id").alias("_first"))
        starts = running_offsets(stage_table(spans, "splits"), ["file", "split"]).drop("_n")
        begun = starts.groupBy("file").agg(F.min("_offset").alias("_begun"))
        record = F.from_json("value", shape, {"mode": "PERMISSIVE",
                                              "columnNameOfCorruptRecord": "_broken"})
        whole = F.trim("value").startswith("{")
        placed = (located.join(starts, ["file", "split"]).join(begun, "file")
                  .withColumn("place", F.col("_offset") + F.col("_id") - F.col("_first"))
                  .where(F.trim("value") != "").withColumn("record", record)
                  .withColumn("bad", ~whole | F.col("record").isNull()
                              | F.col("record._broken").isNotNull()))
        placed = stage_table(placed.select(
            "file", (F.col("place") - F.col("_begun") + 1).alias("line"), "place", "value", "bad",
            "record"), "numbered-lines")
        (placed.where("bad").select("file", "line", "value")
         .write.mode("overwrite").parquet(batch_folder(rejects, batch_id)))
        good = placed.where("NOT bad")
        seen = read_versions(spark, ledger, total, ["name"], before=batch_id).first()
        before = seen.n if seen else 0
        write_version(good.select(F.lit("lines").alias("name")).groupBy("name").agg(
            (F.count("*") + before).alias("n")), ledger, batch_id, ["name"])
        numbered = dense_seq(good.select("place", "record"), ["place"]).select(
            (F.col("seq") + before).alias("seq"), "record.*").drop("_broken")
        own = F.coalesce(F.col(id_field), F.col("seq"))
        return prepare_view(numbered.withColumn("record_id", own), tok, max_len, chat)

    return write_per_batch(lines, out, checkpoint, transform=prepare)
