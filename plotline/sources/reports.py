"""Reports and work lists as files that others read: CSV without geometries, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.operators.survey import scrubbed

NESTED = ("array", "struct", "map", "binary")


def write_table(df: DataFrame, path: str) -> None:
    """CSV files with a header; geometries and other nested columns, which CSV can't hold, are left out."""
    flat = [c for c, kind in df.dtypes if not kind.startswith(NESTED)]
    df.select(*flat).write.csv(path, header=True, emptyValue="", nullValue="")


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document per row; NaN and infinite numbers become null, and nulls are written."""
    scrubbed(df).write.json(path, ignoreNullFields=False)


def read_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The samples of one part of training manifests, a JSON document each: their ``image_path, mask_path`` and file.

    A manifest holds ``splits``, arrays of samples by name; a missing part has no samples.
    """
    sample = "struct<image_path:string,mask_path:string>"
    found = spark.read.schema(f"splits map<string,array<{sample}>>").json(path, multiLine=True).withColumn("manifest", F.col("_metadata.file_path"))
    return found.select("manifest", F.explode(F.try_element_at("splits", F.lit(split))).alias("s")).select("manifest", "s.*")
