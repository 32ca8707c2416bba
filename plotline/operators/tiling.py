"""Sliding-window tiles, weighted stitching, and training chips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def offsets(size: int, tile: int, overlap: float) -> list[int]:
    """Tile offsets along one axis: steps of round(tile (1 - overlap)), the last flush with the edge."""
    if size <= tile:
        return [0]
    stride = max(1, int(round(tile * (1 - overlap))))
    found = list(range(0, size - tile + 1, stride))
    if found[-1] + tile < size:
        found.append(size - tile)
    return found


def tiles(spark: SparkSession, width: int, height: int, tile: int, overlap: float, x0: float = 0.0, y0: float = 0.0, gsd: float = 1.0) -> DataFrame:
    """One row per tile, numbered row by row, with its bounds in the world.

    Offsets follow from a tile's number, so that the plan is as small for a large raster.
    """
    stride = max(1, int(round(tile * (1 - overlap))))
    n_cols, n_rows = (1 if size <= tile else -(-(size - tile) // stride) + 1 for size in (width, height))
    n = F.col("id")
    at = lambda k, size: F.least(k * stride, F.lit(max(size - tile, 0))).cast("int")
    found = spark.range(n_cols * n_rows).select(
        n.cast("int").alias("tile_id"), at(n % n_cols, width).alias("col_off"), at(F.floor(n / n_cols), height).alias("row_off"),
        F.lit(min(tile, width)).alias("width"), F.lit(min(tile, height)).alias("height"),
    )
    return found.withColumns({
        "minx": x0 + F.col("col_off") * gsd, "maxx": x0 + (F.col("col_off") + F.col("width")) * gsd,
        "maxy": y0 - F.col("row_off") * gsd, "miny": y0 - (F.col("row_off") + F.col("height")) * gsd,
    })


def tiled_pixels(pixels: DataFrame, tile_rows: DataFrame) -> DataFrame:
    """Pixels under every tile that covers them, with ``i, j`` inside the tile.

    The tile list is a few rows per megapixel; pixels are matched by their block of one tile's size, so the
    join is on equality. A pixel lies in the blocks of tiles that begin in its own block or the one before.
    """
    block = tile_rows.first()
    if block is None:
        return pixels.limit(0)
    w, h = block["width"], block["height"]
    near = F.explode(F.sequence(F.lit(0), F.lit(1)))
    keyed = tile_rows.withColumn("bx", F.floor(F.col("col_off") / w)).withColumn("by", F.floor(F.col("row_off") / h))
    copies = keyed.withColumn("a", near).withColumn("b", near).withColumn("bx", F.col("bx") + F.col("a")).withColumn("by", F.col("by") + F.col("b")).drop("a", "b")
    placed = pixels.withColumn("bx", F.floor(F.col("col") / w)).withColumn("by", F.floor(F.col("row") / h))
    inside = F.col("col").between(F.col("col_off"), F.col("col_off") + F.col("width") - 1) & F.col("row").between(F.col("row_off"), F.col("row_off") + F.col("height") - 1)
    return placed.join(copies, ["bx", "by"]).where(inside).drop("bx", "by").withColumn("i", F.col("row") - F.col("row_off")).withColumn("j", F.col("col") - F.col("col_off"))


def hann_weight(k: Column, n: Column) -> Column:
    return F.when(n == 1, 1.0).otherwise(0.5 - 0.5 * F.cos(2 * math.pi * k / (n - 1)))


def cosine_weight(k: Column, n: Column) -> Column:
    return F.cos(F.when(n == 1, -math.pi / 2).otherwise(-math.pi / 2 + math.pi * k / (n - 1)))


def stitched(tile_pixels: DataFrame, window: str = "hann", value: str = "v") -> DataFrame:
    """Weighted mean of overlapping tiles per pixel; one aggregation, combined before it shuffles."""
    kind = hann_weight if window == "hann" else cosine_weight
    weight = F.greatest(kind(F.col("i"), F.col("height")) * kind(F.col("j"), F.col("width")), F.lit(1e-4))
    return tile_pixels.withColumn("w_", weight).groupBy("row", "col").agg(
        (F.sum(F.col("w_") * F.col(value)) / F.greatest(F.sum("w_"), F.lit(1e-6))).alias(value)
    )


def chips(pixels: DataFrame, width: int, height: int, chip: int, stride: int, empty: Column, max_empty: float = 0.7) -> DataFrame:
    """Training chips on a grid, partial and mostly empty ones dropped, with their part of the split.

    ``empty`` tells of a pixel whether it has no data. Columns: ``col_off, row_off, share_empty, split``.
    """
    cols, rows = range(0, width - chip + 1, stride), range(0, height - chip + 1, stride)
    reach = -(-chip // stride)
    starts = lambda at, last: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: (F.floor(at / stride) - k) * stride), lambda o: (o >= 0) & (o <= last) & (o + chip > at)
    )
    covered = pixels.withColumn("col_off", F.explode(starts(F.col("col"), cols[-1] if cols else -1))).withColumn("row_off", F.explode(starts(F.col("row"), rows[-1] if rows else -1)))
    found = covered.groupBy("col_off", "row_off").agg(F.avg(empty.cast("double")).alias("share_empty")).where(F.col("share_empty") <= max_empty)
    return found.withColumn("split", spatial_split((F.col("col_off") + chip / 2) / width, (F.col("row_off") + chip / 2) / height))


def spatial_split(rel_x: Column, rel_y: Column) -> Column:
    """West is for training; the rest is for validation above and for testing below."""
    return F.when(rel_x < 0.7, "train").when(rel_y < 0.5, "val").otherwise("test")


def split_counts(found: DataFrame) -> DataFrame:
    """Chips per part of the split, ``split, chips``; an empty ``val`` takes the last of several training chips."""
    counts = found.groupBy("split").agg(F.count("*").alias("chips"))
    wide = counts.agg(*[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("chips"))), F.lit(0)).alias(s) for s in ("train", "val", "test")])
    moved = ((F.col("val") == 0) & (F.col("train") > 1)).cast("long")
    parts = F.array(*[F.struct(F.lit(s).alias("split"), c.alias("chips")) for s, c in (("train", F.col("train") - moved), ("val", F.col("val") + moved), ("test", F.col("test")))])
    return wide.select(F.inline(parts))
