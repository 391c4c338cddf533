"""Session settings and the shared staging folder.

Intermediate tables that several actions read (token arrays, stream state) are
written once to the folder named by ``spark.checkpoint.dir`` and read back as
Parquet: the lineage is cut, columns stay prunable, and a lost executor costs a
re-read instead of a recomputation.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_job: ContextVar[str] = ContextVar("job", default="")


def build_session(app: str = "tuneloom", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    The cluster's own setting always wins. A machine-local folder is only used
    where the setting is missing and the session itself is local.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="tuneloom-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh, never used path below the staging folder, or below that of the current job."""
    return f"{stage_root(spark)}/tuneloom/{_job.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def job_stages(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside are dropped at the end; what leaves the job must be written by then."""
    name = f"job-{uuid.uuid4().hex}/"
    folder = f"{stage_root(spark)}/tuneloom/{name}"
    token = _job.set(name)
    try:
        yield folder
    finally:
        _job.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
