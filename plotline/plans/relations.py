"""Parcels, pixels, points and endpoints derived from the star-schema tables by plain arithmetic.

Each relation has a DataFrame form and the same formula as SQL for checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned boxes with a confidence: ``id, x0, y0, x1, y1, conf``."""
    k = F.col("p_partkey").cast("long")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"))
    base = F.when(F.col("id") % 10 == 9, F.col("id") - 1).otherwise(F.col("id"))
    boxes = part.withColumn("base", base).select(
        "id",
        ((F.col("base") % 50) * 20 + F.when(F.col("id") % 10 == 9, 0.125).otherwise(0.0)).cast("double").alias("x0"),
        (F.floor(F.col("base") / 50) * 20).cast("double").alias("y0"),
        F.when(F.col("base") % 41 == 0, 1.0).when(F.col("base") % 53 == 0, 0.5).otherwise((8 + (7 * F.col("base")) % 17).cast("double")).alias("w"),
        F.when(F.col("base") % 41 == 0, 2.0).when(F.col("base") % 53 == 0, 20.0).otherwise((8 + (11 * F.col("base")) % 19).cast("double")).alias("h"),
        ((37 * F.col("id")) % 100 / 100.0).alias("conf"),
    )
    return boxes.select("id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), "conf")


PARCELS = """parcels AS (
  SELECT id, x0, y0, x0 + w AS x1, y0 + h AS y1, conf FROM (
    SELECT id, CAST((base % 50) * 20 AS DOUBLE) + CASE WHEN id % 10 = 9 THEN 0.125::DOUBLE ELSE 0::DOUBLE END AS x0,
      CAST((base // 50) * 20 AS DOUBLE) AS y0,
      CASE WHEN base % 41 = 0 THEN 1::DOUBLE WHEN base % 53 = 0 THEN 0.5::DOUBLE ELSE CAST(8 + (7 * base) % 17 AS DOUBLE) END AS w,
      CASE WHEN base % 41 = 0 THEN 2::DOUBLE WHEN base % 53 = 0 THEN 20::DOUBLE ELSE CAST(8 + (11 * base) % 19 AS DOUBLE) END AS h,
      CAST((37 * id) % 100 AS DOUBLE) / 100::DOUBLE AS conf
    FROM (SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END::BIGINT AS base FROM part)))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of 64 columns, one row per vector: ``row, col, v``."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "x")).select(
        "row", "col", F.col("x").cast("double").alias("v")
    )


PIXELS = """pixels AS (
  SELECT vec_id::INTEGER AS row, (generate_subscripts(embedding, 1) - 1)::INTEGER AS col, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey points in order of capture: ``seq, user_id, x, y, d``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("long").alias("seq"), F.col("user_id").cast("long").alias("user_id"),
        ((37 * F.col("event_id")) % 1000 + 0.5).cast("double").alias("x"), F.round(F.col("value").cast("double"), 2).alias("y"),
        F.col("value").cast("double").alias("d"),
    )


POINTS = """points AS (
  SELECT event_id::BIGINT AS seq, user_id::BIGINT AS user_id, CAST((37 * event_id) % 1000 AS DOUBLE) + 0.5::DOUBLE AS x,
    round(value::DOUBLE, 2) AS y, value::DOUBLE AS d FROM events)"""


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends: ``seq, line, x, y``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("long").alias("seq"), F.col("user_id").cast("long").alias("line"),
        F.round(F.col("value").cast("double"), 2).alias("x"), ((7919 * F.col("event_id").cast("long")) % 2000 / 10.0).alias("y"),
    )


ENDPOINTS = """endpoints AS (
  SELECT event_id::BIGINT AS seq, user_id::BIGINT AS line, round(value::DOUBLE, 2) AS x,
    CAST((7919 * event_id::BIGINT) % 2000 AS DOUBLE) / 10::DOUBLE AS y FROM events)"""
