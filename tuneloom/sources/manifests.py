"""Run manifests: one schema for both variants, written by append, read with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.functions.text import iso_seconds
from tuneloom.schemas import MANIFEST


def union_manifests(*variants: DataFrame) -> DataFrame:
    """Manifests of different shapes as one table."""
    whole = variants[0]
    for other in variants[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole


def append_run_manifest(df: DataFrame, path: str, created: str = "created",
                        once: bool = False) -> None:
    """Append manifest rows as JSON lines; a timestamp is written as ISO text.

    With ``once`` a manifest that lies there with the same content is not written again, so
    that an append can be retried; one writer at a time.
    """
    if dict(df.dtypes).get(created, "string").startswith("timestamp"):
        df = df.withColumn(created, iso_seconds(created))
    content = F.to_json(F.struct(*sorted(c for c in df.columns if c != "manifest_key")))
    df = df.withColumn("manifest_key", F.sha2(content, 256))
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if once and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.schema("manifest_key string").json(path)
        df = df.join(there, "manifest_key", "left_anti")
    df.write.mode("append").json(path)


def latest_manifests(manifests: DataFrame, by: str = "adapter_path") -> DataFrame:
    """The manifest of each ``by`` that was created last; ties go to the greater content."""
    content = F.to_json(F.struct(*manifests.columns))
    best = F.max_by(F.struct(*manifests.columns), F.struct("created", content))
    return manifests.groupBy(F.col(by).alias("_by")).agg(best.alias("_m")).select("_m.*")


def read_run_manifests(spark: SparkSession, root: str, multi_line: bool = True,
                       name: str = "*.json") -> DataFrame:
    """All manifests below ``root``: one document per file, or JSON lines.

    ``name`` is the file name of a manifest or a pattern; name it where run folders hold other
    JSON files, which are then left alone. ``run_dir`` is the folder a manifest lies in.
    """
    rows = (spark.read.schema(MANIFEST).option("mode", "FAILFAST")
            .option("multiLine", multi_line).option("recursiveFileLookup", True)
            .option("pathGlobFilter", name).json(root))
    return rows.withColumn("run_dir", F.regexp_extract(
        F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1))


def manifests_for(runs: DataFrame, manifests: DataFrame, model: str = "model",
                  on: str | None = None, defaults: bool = True) -> DataFrame:
    """Manifest of each run; a run without one serves as its own base model, unquantised.

    ``defaults=False`` leaves the fields of such a run empty.
    """
    key = on or model
    found = runs.join(manifests.withColumn("_found", F.lit(True)), key, "left")
    if defaults:
        missing = F.col("_found").isNull()
        found = (found.withColumn("base_model", F.when(missing, F.col(model))
                                  .otherwise(F.col("base_model")))
                 .withColumn("quant", F.when(missing, F.lit("none"))
                             .otherwise(F.col("quant"))))
    return found.drop("_found")


def loss_points(manifests: DataFrame, run: str = "base_model") -> DataFrame:
    """The loss history of manifests as long rows ``(run, kind, iter, loss)``."""
    def side(kind: str) -> DataFrame:
        points = manifests.select(run, F.explode(f"loss_history.{kind}").alias("p"))
        return points.select(run, F.lit(kind).alias("kind"),
                             F.get("p", F.lit(0)).cast("bigint").alias("iter"),
                             F.get("p", F.lit(1)).alias("loss"))

    return side("train").unionByName(side("val"))


