"""Validity, rules and automatic fixes of polygons in any position.

Parcels are rows ``id, rings, conf``: an array of rings each, the shell first, closed or not. Ids are longs, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import aspect, polygon_area
from plotline.functions.overlay import ring_rectangle
from plotline.operators.arrangement import DIGITS, made_valid, nonzero, outlined, ring_segments, ring_sizes, sided_pieces, split_within
from plotline.operators.checkpoints import written
from plotline.operators.healing import healed, losers, overlaps, remains
from plotline.operators.validation import DUPLICATE_IOU, OVERLAP_AREA, dropped_duplicates, duplicate_issues, keyed, overlap_issues, shape_issues

#: Reasons for which a polygon isn't valid; of several the first is reported.
NO_GEOMETRY, COORDINATE, POINTS, MEETS, OVERLAP, APART = (
    "no geometry", "invalid coordinate", "too few points", "ring meets itself", "rings overlap", "interior is cut apart",
)
FAULTS = (NO_GEOMETRY, COORDINATE, POINTS, MEETS, OVERLAP, APART)


def _row_fault() -> Column:
    """The faults that a row shows by itself."""
    shell = F.get("rings", F.lit(0))
    unlike = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    held = F.filter("rings", lambda r: F.size(r) > 0)
    odd = F.exists(held, lambda r: F.exists(r, lambda p: p.isNull() | unlike(p["x"]) | unlike(p["y"])))
    at = lambda p: F.struct((F.round(p["x"], DIGITS) + 0.0).alias("x"), (F.round(p["y"], DIGITS) + 0.0).alias("y"))
    few = F.exists(held, lambda r: F.size(F.array_distinct(F.transform(r, at))) < 3)
    return F.when(shell.isNull() | (F.size(shell) <= 0), NO_GEOMETRY).when(odd, COORDINATE).when(few, POINTS)


def faults(parcels: DataFrame) -> DataFrame:
    """``id, fault, x, y``: polygons that aren't valid, with the reason and the least of the vertices that show it.

    Valid means: a shell; numbers as coordinates; three different points or more in every ring; no ring that crosses,
    touches or retraces itself; holes inside the shell and outside one another, which may touch at single points
    and do not cut the interior apart. Two vertices closer than the rounding of ``arrangement`` are one. Null and empty
    holes count as absent. The first three reasons have no vertex.

    Within a shape every segment is cut where it meets another one. A ring that leaves a vertex twice meets itself there.
    With shells run one way and holes the other, winding numbers are 0 and 1 alone where rings do not overlap.
    """
    known = written(parcels.select(F.col("id").cast("long").alias("id"), "rings").withColumn("fault", _row_fault()))
    none = F.lit(None).cast("double")
    shown = known.where("fault is not null").select("id", "fault", none.alias("x"), none.alias("y"))
    sound = known.where("fault is null")
    pieces = written(split_within(ring_segments(sound, "id", F.col("rings"), None), ring_sizes(sound, "id", "rings")))
    first = lambda df, fault: df.groupBy("shape").agg(F.min(F.struct("ax", "ay")).alias("v")).select(F.col("shape").alias("id"), F.lit(fault).alias("fault"), F.col("v.ax").alias("x"), F.col("v.ay").alias("y"))
    met = written(first(pieces.groupBy("shape", "side", "ax", "ay").agg(F.count("*").alias("n")).where("n > 1"), MEETS))
    found = shown.unionByName(met)
    # Only a shape of several rings can have the other faults.
    several = sound.where(F.size(F.filter("rings", lambda r: F.size(r) > 0)) > 1).join(met.select("id"), "id", "left_anti").select(F.col("id").alias("shape"))
    rings = written(pieces.join(several, "shape").withColumn("side", F.lit(0)))
    if not rings.head(1):
        return found
    forth = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    way = lambda a, b, name: F.when(forth, F.col(a)).otherwise(F.col(b)).alias(name)
    ends = rings.select("shape", way("ax", "bx", "ax"), way("ay", "by", "ay"), way("bx", "ax", "bx"), way("by", "ay", "by"))
    common = ends.groupBy("shape", "ax", "ay", "bx", "by").agg(F.count("*").alias("n")).where("n > 1").select("shape", "ax", "ay")
    sided = written(sided_pieces(rings, 1))
    wound = sided.where((F.least("left_0", "right_0") < 0) | (F.greatest("left_0", "right_0") > 1)).select("shape", "ax", "ay")
    over = written(first(common.unionByName(wound), OVERLAP))
    # The interior is cut apart only where rings meet in vertices.
    corners = rings.groupBy("shape", "ax", "ay").agg(F.count("*").alias("n")).where("n > 1").join(over.select(F.col("id").alias("shape")), "shape", "left_anti")
    corners = written(corners.select("shape", "ax", "ay"))
    if not corners.head(1):
        return found.unionByName(over)
    clean = sided.join(corners.select("shape").distinct(), "shape", "left_semi")
    cut = outlined(clean, nonzero).groupBy("shape").agg(F.count("*").alias("n")).where("n > 1")
    return found.unionByName(over).unionByName(first(corners.join(cut.select("shape"), "shape"), APART))


def _with_iou(pairs: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs ``a_id, b_id, shared`` with ``iou``; errors below the rounding of vertices go."""
    of = lambda p: areas.select(F.col("id").alias(f"{p}_id"), F.col("area").alias(f"{p}_area"))
    both = pairs.join(of("a"), "a_id").join(of("b"), "b_id")
    return both.withColumn("shared", F.round("shared", DIGITS)).withColumn("iou", F.round(F.try_divide(F.col("shared"), F.col("a_area") + F.col("b_area") - F.col("shared")), DIGITS))


def polygon_issues(parcels: DataFrame, cell: float, tolerance: float = OVERLAP_AREA, threshold: float = DUPLICATE_IOU) -> DataFrame:
    """The issues of ``validation.issues`` for polygons: faults, overlaps, duplicates, slivers and needles.

    Only valid polygons are held to the rules after the first. The aspect is that of the smallest turned rectangle
    around the shell. ``cell`` should be about as large as typical parcels.
    """
    known = written(parcels.select(F.col("id").cast("long").alias("id"), "rings", F.coalesce("conf", F.lit(0.5)).alias("conf")))
    bad = written(faults(known))
    sound = written(known.join(bad.select("id"), "id", "left_anti").withColumn("area", F.round(polygon_area(F.col("rings")), DIGITS)))
    broken = bad.select(
        F.lit(1).alias("rule"), F.col("id").alias("first_id"), F.lit(None).cast("long").alias("second_id"), F.lit("invalid").alias("type"), F.lit("error").alias("severity"),
        F.col("id").cast("string").alias("feature_ids"), F.col("fault").alias("message"), F.when(F.col("fault") == NO_GEOMETRY, "delete").otherwise("make_valid").alias("auto_fix"),
    )
    pairs = written(_with_iou(overlaps(sound, cell), sound))
    boxed = sound.withColumn("r", ring_rectangle(F.get("rings", F.lit(0))))
    shapes = shape_issues(boxed, F.col("area"), F.round(aspect(F.col("r.short"), F.col("r.long")), DIGITS))
    found = broken.unionByName(overlap_issues(pairs.where(F.col("shared") > tolerance))).unionByName(duplicate_issues(pairs.where(F.col("iou") > threshold)))
    return keyed(found.unionByName(shapes))


def auto_fixed(parcels: DataFrame, cell: float, tolerance: float = OVERLAP_AREA, threshold: float = DUPLICATE_IOU) -> tuple[DataFrame, DataFrame]:
    """Parcels repaired, without duplicates and without overlaps, and what was done to them.

    The parcels are ``id, rings, area, clips``, a row per part. First polygons that aren't valid become their valid
    parts; then of duplicates the one of higher confidence stays, as ``heal_duplicates`` says; then overlaps are cut
    out of the parcel of lower confidence, as ``healed_overlaps`` says. Areas that parcels share are found once, as
    dropping some does not change the others. A parcel that can't be repaired, as it has no area, stays as it was with
    an area of 0 and takes no part. Null confidences count as 0.5.

    The second table has ``id, action, against``: ``make_valid``, ``drop_duplicate``, and ``clip_overlap`` for every
    parcel ``against`` which one was cut; a parcel that would have kept nothing was not cut.
    """
    known = written(parcels.select(F.col("id").cast("long").alias("id"), "rings", F.coalesce("conf", F.lit(0.5)).alias("conf")))
    bad = written(faults(known).select("id", "fault"))
    mend = known.join(bad.where(F.col("fault") != NO_GEOMETRY).select("id"), "id", "left_semi")
    parts = written(made_valid(mend, "id", "rings").select(F.col("shape").alias("id"), "rings"))
    mended = written(parts.select("id").distinct())
    hopeless = known.join(bad.join(mended, "id", "left_anti").select("id"), "id", "left_semi")
    sound = written(known.join(bad.select("id"), "id", "left_anti").unionByName(parts.join(known.select("id", "conf"), "id").select("id", "rings", "conf")))
    areas = sound.groupBy("id").agg(F.sum(polygon_area(F.col("rings"))).alias("area"))
    pairs = written(_with_iou(overlaps(sound, cell), areas))
    twice = pairs.where(F.col("iou") > threshold).select("a_id", "b_id", (F.col("a_conf") >= F.col("b_conf")).alias("keep_a"))
    gone = written(dropped_duplicates(twice))
    kept = written(sound.join(gone, "id", "left_anti"))
    lost = losers(pairs.where(F.col("shared") > tolerance)).join(gone, "id", "left_anti")
    lost = written(lost.join(gone.withColumnRenamed("id", "above"), "above", "left_anti").select("id", "above"))
    cut = remains(kept, lost)
    rest = hopeless.select("id", "rings", F.lit(0.0).alias("area"), F.lit(0).cast("long").alias("clips"))
    done = lambda df, action, against: df.select("id", F.lit(action).alias("action"), against.cast("long").alias("against"))
    clips = lost.join(cut.select("id").distinct(), "id", "left_semi")
    audit = done(mended, "make_valid", F.lit(None)).unionByName(done(gone, "drop_duplicate", F.lit(None))).unionByName(done(clips, "clip_overlap", F.col("above")))
    return healed(kept, lost, cut).unionByName(rest), audit
