"""Touching instances told apart by a watershed, as a minimum spanning forest of the pixels.

Flooding a relief from markers gives every pixel the marker that reaches it over the lowest pass. The
cheapest edges between pixels, an edge being as high as its higher end, make a spanning forest with one
marker per tree, and its trees are such a flooding. Boruvka's rounds build it without an order of pixels:
each part that holds no marker joins the neighbour over its lowest edge, all at once. So seams of tiles
need no care, and a logarithmic number of rounds of joins does it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators.checkpoints import written
from plotline.operators.components import connected_components
from plotline.operators.raster import local_maxima, neighbours
from plotline.operators.vectorise import ROW


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("pixel", F.col("row").cast("long") * F.lit(ROW) + F.col("col").cast("long"))


def components(df: DataFrame) -> DataFrame:
    """``pixel, component`` of set pixels ``row, col``; the component is its smallest pixel number."""
    parts = connected_components(neighbours(df), cut=written).withColumnRenamed("node", "pixel")
    return _numbered(df.select("row", "col")).join(parts, "pixel", "left").select("pixel", F.coalesce("component", "pixel").alias("component"))


def flooded(relief: DataFrame, markers: DataFrame) -> DataFrame:
    """``row, col, label``: set pixels ``row, col, v`` by the marker that floods them over the lowest pass.

    ``markers`` are ``pixel, component``: pixel numbers (row * 2^32 + col) and the marker each belongs to, the
    number of one of its pixels. Pixels touch by their edges. Where two passes are equally high the one whose
    lower side is lower counts, then the smaller pixel numbers. Pixels that no marker reaches have a null label.
    """
    cells = written(_numbered(relief.select("row", "col", F.col("v").cast("double").alias("v"))))
    # Parts with a marker are numbered below 0, so that the smallest number of a merged part is its marker's.
    marked = markers.select("pixel", (-1 - F.col("component")).alias("part"))
    parts = written(cells.select("pixel").join(marked, "pixel", "left").select("pixel", F.coalesce("part", "pixel").alias("part")))
    value = cells.select("pixel", "v")
    links = neighbours(cells)
    at = lambda side: value.withColumnsRenamed({"pixel": side, "v": f"v_{side}"})
    height = F.struct(F.greatest("v_src", "v_dst").alias("high"), F.least("v_src", "v_dst").alias("low"), F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"))
    edges = links.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", height.alias("w"))

    def contracted(edges: DataFrame, renamed: DataFrame) -> DataFrame:
        """The lowest edge between any two parts, those between two marked ones left out."""
        to = lambda side: renamed.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}"))
        moved = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
        ends = moved.select(F.coalesce("new_src", "src").alias("a"), F.coalesce("new_dst", "dst").alias("b"), "w").where("a <> b and (a >= 0 or b >= 0)")
        return ends.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("w").alias("w"))

    edges = written(contracted(edges, parts.where("part < 0").select(F.col("pixel").alias("old"), F.col("part").alias("new"))))
    while edges.head(1):
        both = edges.select(F.col("src").alias("part"), F.col("dst").alias("to"), "w").unionByName(edges.select(F.col("dst").alias("part"), F.col("src").alias("to"), "w"))
        chosen = both.where("part >= 0").groupBy("part").agg(F.min_by("to", "w").alias("to"))
        merged = connected_components(chosen.withColumnsRenamed({"part": "src", "to": "dst"}), cut=written).select(F.col("node").alias("old"), F.col("component").alias("new"))
        merged = written(merged.where("old <> new"))
        parts = written(parts.join(merged.withColumnRenamed("old", "part"), "part", "left").select("pixel", F.coalesce("new", "part").alias("part")), parts)
        edges = written(contracted(edges, merged), edges)
    return cells.join(parts, "pixel").select("row", "col", F.when(F.col("part") < 0, -1 - F.col("part")).alias("label"))


def instances(df: DataFrame, distance: str = "distance", reach: int = 2, least: float = 2.0) -> DataFrame:
    """``row, col, label``: set pixels split at the narrow places between their peaks of distance.

    ``df`` holds the set pixels alone, with their (weighted) distance to the edge. Peaks are the pixels that
    are largest of their block and above ``least``; those that touch by their edges are one marker. With two
    markers or more pixels that none of them reaches have a null label; with fewer every component is an
    instance. A label is the smallest pixel number of its marker or component.
    """
    known = written(df.select("row", "col", F.col(distance).cast("double").alias("v")))
    peaks = local_maxima(known, "v", reach, least).where("peak").select("row", "col")
    markers = written(components(peaks))
    if markers.select("component").distinct().limit(2).count() < 2:
        return _numbered(known).join(components(known), "pixel").select("row", "col", F.col("component").alias("label"))
    return flooded(known.withColumn("v", -F.col("v")), markers)
