"""Repair and healing of polygons in any position: self-crossings, and overlaps by priority.

Polygons are rows ``id, rings, conf``: arrays of rings, the shell first. A parcel may have several rows, its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import polygon_area, ring_bounds
from plotline.operators.arrangement import combined, made_valid, nonzero, overlaid, ring_segments
from plotline.operators.checkpoints import written
from plotline.operators.spatial_join import meeting_pairs


def repaired(parcels: DataFrame) -> DataFrame:
    """``id, part, rings, area, perimeter, conf``: every parcel as its valid parts, by the even-odd rule.

    Parcels without area have no part and are left out. Ids are longs, each once.
    """
    parts = made_valid(parcels, "id", "rings").withColumnRenamed("shape", "id")
    return parts.join(parcels.select("id", "conf"), "id")


def overlaps(parcels: DataFrame, cell: float) -> DataFrame:
    """``a_id, b_id, a_conf, b_conf, shared``: pairs of parcels that share area, ``a_id`` below ``b_id``; parts are summed."""
    boxed = parcels.select("id", "conf", "rings", ring_bounds(F.get("rings", F.lit(0))).alias("b")).select("id", "conf", "rings", "b.*")
    pairs = written(meeting_pairs(boxed, boxed, cell, F.col("a_id") < F.col("b_id")).withColumn("pair", F.monotonically_increasing_id()))
    shared = overlaid(pairs, "pair", "a_rings", "b_rings", "intersection").groupBy(F.col("shape").alias("pair")).agg(F.sum("area").alias("shared"))
    known = ("a_id", "b_id", "a_conf", "b_conf")
    return pairs.join(shared, "pair").groupBy(*known).agg(F.sum("shared").alias("shared"))


def healed_overlaps(parcels: DataFrame, cell: float, tolerance: float = 0.05) -> DataFrame:
    """``id, rings, area, clips``, a row per part: overlaps cut out of the parcel of lower confidence.

    Of a pair that shares more than ``tolerance`` the parcel of higher confidence keeps the overlap, ties go
    to the smaller id, so that the order of pairs doesn't matter: a parcel keeps what no parcel above it in
    this order takes. One that would keep nothing stays as it is. ``clips`` counts those above it that it
    overlaps. Parcels that lose nothing come back as they were, in their parts; confidences that are null count
    as 0.5.
    """
    known = written(parcels.select("id", "rings", F.coalesce("conf", F.lit(0.5)).alias("conf")))
    lost = written(losers(overlaps(known, cell).where(F.col("shared") > tolerance)))
    return healed(known, lost, remains(known, lost))


def losers(pairs: DataFrame) -> DataFrame:
    """``id, above``: of each pair the parcel that gives way, and the one that keeps the overlap."""
    first = F.col("a_conf") >= F.col("b_conf")
    return pairs.select(F.when(first, F.col("b_id")).otherwise(F.col("a_id")).alias("id"), F.when(first, F.col("a_id")).otherwise(F.col("b_id")).alias("above"))


def remains(known: DataFrame, lost: DataFrame) -> DataFrame:
    """``id, rings, area``, a row per part: what parcels keep that give way; written. One that keeps nothing has no row."""
    own = known.join(lost.select("id").distinct(), "id", "left_semi")
    above = lost.join(known.select(F.col("id").alias("above"), "rings"), "above")
    segments = ring_segments(own, "id", F.col("rings"), 0).unionByName(ring_segments(above, "id", F.col("rings"), 1))
    return written(combined(segments, lambda mine, theirs: nonzero(mine) & ~nonzero(theirs), 2).select(F.col("shape").alias("id"), "rings", "area"))


def healed(known: DataFrame, lost: DataFrame, cut: DataFrame) -> DataFrame:
    """``id, rings, area, clips``: the parts in ``cut``, and as they were the parcels that have none there."""
    clips = lost.groupBy("id").agg(F.count("*").alias("clips"))
    whole = known.join(cut.select("id").distinct(), "id", "left_anti").join(clips, "id", "left")
    stays = whole.select("id", "rings", polygon_area(F.col("rings")).alias("area"), F.coalesce("clips", F.lit(0)).cast("long").alias("clips"))
    return cut.join(clips, "id").select("id", "rings", "area", "clips").unionByName(stays)
