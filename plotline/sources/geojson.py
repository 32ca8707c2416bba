"""GeoJSON feature collections to and from relations of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``pos, properties, geometry, kind, rings``: one row per feature, polygons as arrays of rings.

    A file is a feature collection, or has one feature per line; ``pos`` counts within a collection and is
    null for lines. Properties stay a JSON string, as every layer has its own. Features without a geometry, or with an
    empty one, are dropped; others than polygons have null rings and keep their ``geometry`` as JSON.
    """
    kind = F.get_json_object("value", "$.type")
    named = lambda df: df.select("value", F.col("_metadata.file_path").alias("file"))
    # Only files that name a collection are read whole, so that files of lines may have any size.
    collections = [r["file"] for r in named(spark.read.text(path)).where(F.col("value").contains("FeatureCollection")).select("file").distinct().collect()]
    nothing = spark.createDataFrame([], "value string, file string")
    whole = named(spark.read.text(collections, wholetext=True)).where(kind == "FeatureCollection") if collections else nothing
    lines = named(spark.read.text(path)).where(kind == "Feature")
    single = lines.join(whole.select("file"), "file", "left_anti").select(F.lit(None).cast("int").alias("pos"), F.col("value").alias("f"))
    inside = whole.select(F.from_json("value", "features array<string>").alias("c")).select(F.posexplode("c.features").alias("pos", "f"))
    features = inside.unionByName(single).select(
        "pos", F.get_json_object("f", "$.properties").alias("properties"), F.get_json_object("f", "$.geometry").alias("geometry")
    ).where("geometry is not null").withColumn("kind", F.get_json_object("geometry", "$.type"))
    nested = F.from_json(F.get_json_object("geometry", "$.coordinates"), "array<array<array<double>>>")
    rings = F.transform(nested, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    found = features.withColumn("rings", F.when(F.col("kind") == "Polygon", rings))
    return found.where((F.col("kind") != "Polygon") | (F.size("rings") > 0))


def feature_json(kind, coordinates, properties):
    """A feature as a JSON string; NaN and infinite numbers must have been scrubbed."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def write_features(df: DataFrame, path: str, rings: str, properties: list[str]) -> None:
    """One GeoJSON feature per line, in as many files as partitions; ``read_features`` reads them."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    df.select(feature_json(F.lit("Polygon"), coordinates, F.struct(*properties)).alias("value")).write.text(path)
