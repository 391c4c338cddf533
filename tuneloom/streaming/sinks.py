"""Replayable stream sinks and progress hooks.

Each micro-batch writes its own folder and overwrites it when it is retried, so
a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch={batch_id}"


def write_per_batch(stream: DataFrame, out: str, checkpoint: str, mode: str = "append",
                    transform: Callable[[DataFrame, int], DataFrame] | None = None,
                    available_now: bool = True) -> StreamingQuery:
    def write(rows: DataFrame, batch_id: int) -> None:
        done = transform(rows, batch_id) if transform else rows
        done.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    writer = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
              .foreachBatch(write))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_observed(stream: DataFrame, out: str, metrics: str, checkpoint: str,
                   measures: list[Column], keep: Callable[[DataFrame], DataFrame] | None = None,
                   available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch, and one row of ``measures`` over it, taken on the same pass.

    ``keep`` is applied after the measures are taken. A retried batch overwrites its rows and
    its measures, so sums over ``metrics`` count every row once.
    """
    schema = stream.sparkSession.createDataFrame([], stream.schema).agg(*measures).schema

    def write(rows: DataFrame, batch_id: int) -> None:
        observation = Observation(f"batch-{batch_id}")
        seen = rows.observe(observation, *measures)
        done = keep(seen) if keep else seen
        done.write.mode("overwrite").parquet(batch_folder(out, batch_id))
        found = observation.get
        row = tuple(found[name] for name in schema.names)
        (rows.sparkSession.createDataFrame([row], schema).coalesce(1)
         .write.mode("overwrite").parquet(batch_folder(metrics, batch_id)))

    writer = (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_batches(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All micro-batches of a sink, with their number in ``batch``."""
    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    return spark.read.schema(numbered).parquet(out)


class ProgressLog(StreamingQueryListener):
    """Calls ``hook(name, batch_id, rows, rows_per_s)`` after every micro-batch."""

    def __init__(self, hook: Callable[[str | None, int, int, float], None]):
        self.hook = hook

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.hook(p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
