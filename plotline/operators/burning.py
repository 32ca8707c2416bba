"""Polygons and lines burned into pixels, by spans of raster lines.

Map coordinates become pixel coordinates with ``x0, y0, gsd``; without ``y0`` rows count up with y, with it
they count down from the top. Spans are spelled out by the shape's own edges: nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.checkpoints import dealt
from plotline.operators.zonal import majority


def _pixel_edges(rings: Column, x0: float, y0: float | None, gsd: float) -> Column:
    """All edges of an array of rings in pixel coordinates, each ring closed."""
    def edges(ring: Column) -> Column:
        at = F.transform(ring, lambda p: F.struct(((p["x"] - x0) / gsd).alias("x"), (p["y"] / gsd if y0 is None else (y0 - p["y"]) / gsd).alias("y")))
        after = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, 1))
        return F.zip_with(at, after, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))

    return F.flatten(F.transform(rings, edges))


def _rows(low: Column, high: Column) -> Column:
    return F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<long>")))


def inside_pixels(shapes: DataFrame, key: str, rings: Column, x0: float = 0.0, y0: float | None = None, gsd: float = 1.0) -> DataFrame:
    """``key, row, col``: pixels whose centre lies inside the rings, by the even-odd rule; holes are not.

    Each edge gives the place at which it crosses every raster line's centre; between the first and second, third
    and fourth, ... crossing of a line lie the pixels. A centre on the left or lower edge counts, on the
    right or upper one not, so that neighbours share no pixel. Shapes of several rows under one key are one shape.
    """
    edge = dealt(shapes).select(F.col(key), F.explode(_pixel_edges(rings, x0, y0, gsd)).alias("e")).select(key, "e.*").where("ay <> by")
    low, high = F.ceil(F.least("ay", "by") - 0.5), F.ceil(F.greatest("ay", "by") - 0.5) - 1
    lines = edge.withColumn("row", _rows(low, high))
    cross = F.col("ax") + (F.col("row") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    sorted_ = lines.groupBy(key, "row").agg(F.array_sort(F.collect_list(cross)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))
    span = sorted_.where(F.size("xs") > 1).select(key, "row", F.explode(spans).alias("s"))
    pixels = span.withColumn("col", _rows(F.ceil(F.col("s.a") - 0.5), F.ceil(F.col("s.b") - 0.5) - 1))
    return pixels.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def touched_pixels(segments: DataFrame, key: str, x0: float = 0.0, y0: float | None = None, gsd: float = 1.0) -> DataFrame:
    """``key, row, col``: all pixels that segments ``ax, ay, bx, by`` pass through, each once per key.

    A pixel holds its left and lower edges. A segment is cut into raster lines, and in each it covers the
    columns between where it enters and leaves.
    """
    x = lambda c: (F.col(c) - x0) / gsd
    y = lambda c: F.col(c) / gsd if y0 is None else (y0 - F.col(c)) / gsd
    placed = dealt(segments).select(F.col(key), x("ax").alias("ax"), y("ay").alias("ay"), x("bx").alias("bx"), y("by").alias("by"))
    # From the lower end to the upper one.
    up = F.col("ay") <= F.col("by")
    way = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    risen = placed.select(key, way("ax", "bx").alias("ax"), way("ay", "by").alias("ay"), way("bx", "ax").alias("bx"), way("by", "ay").alias("by"))
    line = risen.withColumn("row", _rows(F.floor("ay"), F.floor("by")))
    level = F.col("ay") == F.col("by")
    at = lambda v: F.when(v <= F.col("ay"), F.col("ax")).when(v >= F.col("by"), F.col("bx")).otherwise(F.col("ax") + (v - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
    enter = F.when(level, F.col("ax")).otherwise(at(F.col("row").cast("double")))
    leave = F.when(level, F.col("bx")).otherwise(at(F.col("row") + 1.0))
    ends = line.select(key, "row", enter.alias("i"), leave.alias("o"), (F.col("by") >= F.col("row") + 1).alias("open"))
    # What leaves upwards to the right isn't in the column that begins where it leaves.
    high = F.when(F.col("open") & (F.col("o") > F.col("i")), F.ceil("o") - 1).otherwise(F.floor(F.greatest("i", "o")))
    low = F.floor(F.least("i", "o"))
    cells = ends.withColumn("col", _rows(low, F.greatest(low, high)))
    return cells.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()


def ring_edges(shapes: DataFrame, key: str, rings: Column) -> DataFrame:
    """``key, ax, ay, bx, by``: the edges of all rings."""
    return shapes.select(F.col(key), F.explode(_pixel_edges(rings, 0.0, None, 1.0)).alias("e")).select(key, "e.*")


def zone_classes(shapes: DataFrame, key: str, rings: Column, pixels: DataFrame, value: str, spare: int, spare_share: float = 0.5) -> DataFrame:
    """``key, value, share``: the most frequent value of the pixels in each shape; shapes without any take the spare one."""
    # Shapes are spelled out to pixels, of which Spark's estimate knows nothing; so neither side is broadcast.
    inside = inside_pixels(shapes, key, rings).join(pixels.where(F.col(value).isNotNull()).hint("merge"), ["row", "col"])
    found = majority(inside, key, value)
    return shapes.select(key).distinct().join(found, key, "left").select(key, F.coalesce(value, F.lit(spare)).alias(value), F.coalesce("share", F.lit(spare_share)).alias("share"))
