"""Joins and aggregates between pixels and polygons, land-use refinement, and rasterisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.checkpoints import dealt

# Land-use classes by number.
CLASSES = {0: "background", 1: "residential", 2: "commercial", 3: "institutional", 4: "open_land", 5: "vegetation", 6: "water", 7: "road", 8: "built_up_other"}


def burned(boxes: DataFrame, gsd: float = 1.0, x0: float = 0.0, y0: float | None = None) -> DataFrame:
    """Pixels whose centre lies in a box: ``row, col`` and the box's columns.

    Boxes spell out their own rows and columns, so nothing is joined; they are dealt to tasks before, as a small file
    of them is read by one. With ``y0`` rows count down from the
    top; without it they count up with y.
    """
    low = lambda v: F.ceil(v / gsd - 0.5)
    high = lambda v: F.ceil(v / gsd - 0.5) - 1
    top, bottom = (F.col("y0"), F.col("y1")) if y0 is None else (y0 - F.col("y1"), y0 - F.col("y0"))
    span = lambda a, b: F.explode(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<long>")))
    return dealt(boxes).withColumn("row", span(low(top), high(bottom))).withColumn("col", span(low(F.col("x0") - x0), high(F.col("x1") - x0))).withColumns(
        {"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}
    )


def rasterized(boxes: DataFrame, value: str, order: str, gsd: float = 1.0) -> DataFrame:
    """``row, col, value``: boxes burned in order, later ones over earlier ones."""
    return burned(boxes, gsd).groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def majority(zones: DataFrame, zone: str, value: str) -> DataFrame:
    """Most frequent value per zone with its share; ties to the smallest value."""
    counts = zones.groupBy(zone, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(zone).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b"), F.sum("n").alias("total"))
    return best.select(zone, F.col(f"b.{value}").alias(value), (F.col("b.n") / F.col("total")).alias("share"))


def refined_landuse(name: Column, conf: Column, height: Column, tall: float = 3.5, flat: float = 0.3) -> tuple[Column, Column]:
    """Tall open ground is residential, flat built ground open land; null heights change nothing."""
    is_tall = (height > tall) & name.isin("vegetation", "water", "open_land")
    is_flat = (height < flat) & name.isin("commercial", "institutional")
    return (
        F.when(is_tall, "residential").when(is_flat, "open_land").otherwise(name),
        F.when(is_tall, F.greatest(conf, F.lit(0.75))).otherwise(conf),
    )


def class_name(number: Column) -> Column:
    """Name of a land-use class, ``residential`` for unknown numbers."""
    table = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.lit("residential"))


def class_number(name: Column) -> Column:
    """Number of a land-use class by its trimmed lower-case name, 0 for unknown ones."""
    table = F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (v, k)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit(0))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Features per land use: lower case, the first underscore a space, missing ones ``other``."""
    name = F.lower(F.col(column))
    at = F.locate("_", name)
    clean = F.when(at > 0, F.concat(F.substr(name, F.lit(1), at - 1), F.lit(" "), F.substr(name, at + 1))).otherwise(name)
    return df.select(F.coalesce(clean, F.lit("other")).alias("landuse")).groupBy("landuse").agg(F.count("*").alias("features"))
