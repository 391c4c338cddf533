"""A keyed table that a stream keeps up to date: a snapshot and the deltas after it.

Each micro-batch writes the rows it has touched as a delta of its own number, overwritten when
the batch is retried. Every ``every`` batches the deltas are folded into a new snapshot. A folder
counts once its ``_SUCCESS`` marker, the last file written, is there, so a torn write is not read.
Folders are removed only when a later snapshot and the one before it are complete: a reader that
has opened the older one can end, and a retried batch still finds what was before it. So a table
of any age is two snapshots and twice ``every`` deltas at most.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

EVERY = 16
_NAME = re.compile(r"(snapshot|delta)-(\d+)")


def _folders(spark: SparkSession, out: str) -> dict[str, list[int]]:
    """Numbers of the complete snapshots and deltas."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {"snapshot": [], "delta": []}
    if files.exists(path):
        for status in files.listStatus(path):
            name = _NAME.fullmatch(status.getPath().getName())
            if name and files.exists(spark._jvm.org.apache.hadoop.fs.Path(
                    status.getPath(), "_SUCCESS")):
                found[name[1]].append(int(name[2]))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_versions(spark: SparkSession, out: str, schema: StructType, keys: list[str],
                  before: int | None = None) -> DataFrame:
    """The newest row of each key, of batches below ``before`` if that is given.

    Opens one snapshot and the deltas after it. No folder gives no rows.
    """
    found = _folders(spark, out)
    last = [n for n in found["snapshot"] if before is None or n < before][-1:]
    deltas = [n for n in found["delta"] if (not last or n > last[0])
              and (before is None or n < before)]
    paths = [f"{out}/snapshot-{n}" for n in last] + [f"{out}/delta-{n}" for n in deltas]
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    if not paths:
        return spark.createDataFrame([], schema)
    values = [c for c in schema.names if c not in keys]
    rows = spark.read.schema(numbered).parquet(*paths)
    return (rows.groupBy(*keys).agg(F.max_by(F.struct("batch", *values), "batch").alias("_v"))
            .select(*[c if c in keys else F.col(f"_v.{c}").alias(c) for c in schema.names]))


def write_version(rows: DataFrame, out: str, batch_id: int, keys: list[str],
                  every: int = EVERY) -> None:
    """Write the touched rows of a micro-batch, and fold the table when it is time to."""
    spark = rows.sparkSession
    number = F.lit(batch_id).cast("bigint").alias("batch")
    rows.select("*", number).write.mode("overwrite").parquet(f"{out}/delta-{batch_id}")
    if (batch_id + 1) % every:
        return
    if batch_id not in _folders(spark, out)["snapshot"]:
        now = read_versions(spark, out, rows.schema, keys, before=batch_id + 1)
        now.select("*", number).write.mode("overwrite").parquet(f"{out}/snapshot-{batch_id}")
    found = _folders(spark, out)
    kept = ([n for n in found["snapshot"] if n < batch_id] or [-1])[-1]
    for kind, numbers in found.items():
        for n in numbers:
            if n < kept or kind == "delta" and n == kept:
                _remove(spark, f"{out}/{kind}-{n}")


def keep_versions(stream: DataFrame, out: str, checkpoint: str, keys: list[str],
                  every: int = EVERY) -> StreamingQuery:
    """Keep the table of an aggregate's rows, of which a micro-batch brings those that changed."""
    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda rows, batch: write_version(rows, out, batch, keys, every))
            .trigger(availableNow=True).start())
