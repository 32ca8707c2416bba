"""Features out of rasters and lines: building footprints, roads, and parcels from the faces of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.functions.geometry import compactness, polygon_area, ring_area, ring_bounds, ring_centroid
from plotline.functions.overlay import ring_orthogonal, ring_simplified
from plotline.operators.arrangement import dissolved, lines_buffered, overlaid
from plotline.operators.checkpoints import written
from plotline.operators.faces import face_polygons
from plotline.operators.network import graph_edges, noded
from plotline.operators.raster import dilate, distance_transform, erode, opened_closed, thin, weighted_distance, world_to_pixel
from plotline.operators.spatial_join import meeting_pairs
from plotline.operators.tracing import center_lines
from plotline.operators.vectorise import polygons, regions, ring_corners
from plotline.operators.watershed import instances


def footprints(
    pixels: DataFrame, x0: float = 0.0, y0: float = 0.0, gsd: float = 1.0, threshold: float = 0.5, least_area: float = 4.0, tolerance: float = 1.5,
) -> DataFrame:
    """``region, rings, area, confidence, height``: buildings of ``row, col, p, height`` (probability, metres above ground).

    The mask is opened and closed, its instances are split at the narrow places between their peaks of distance
    weighted by height, and become polygons. Those under ``least_area`` go. Shells are simplified by ``tolerance``
    pixels, and squared where that keeps their shape; holes are simplified. Probability and height are those of the
    pixel at the shell's centroid; a null height counts as 0.
    """
    known = written(pixels.select("row", "col", "p", "height"))
    mask = written(opened_closed(known.select("row", "col", (F.col("p") >= threshold).cast("int").alias("v"))))
    inside = distance_transform(mask.select("row", "col", (F.col("v") == 1).alias("inside"))).where("inside")
    # A mask without any background has no distance.
    near = inside.join(known.select("row", "col", "height"), ["row", "col"]).withColumn("distance", weighted_distance(F.coalesce("distance", F.lit(1.0)), F.col("height")))
    labels = instances(near.select("row", "col", "distance")).where("label is not null")
    shapes = polygons(ring_corners(written(regions(labels))), x0, y0, gsd).where(F.col("area") >= least_area)
    # The shell is simplified first; a ring that would lose its area stays as it is.
    ring = shapes.select("region", F.posexplode("rings").alias("k", "ring")).withColumn("simple", ring_simplified(F.col("ring"), tolerance * gsd))
    ring = ring.withColumn("simple", F.when(ring_area(F.col("simple")) > 0, F.col("simple")).otherwise(F.col("ring")))
    squared = ring.withColumn("made", F.when(F.col("k") == 0, ring_orthogonal("simple")).otherwise(F.col("simple")))
    whole = squared.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "made"))), lambda r: r["made"]).alias("rings"))
    placed = whole.withColumn("c", ring_centroid(F.get("rings", F.lit(0))))
    row, col = world_to_pixel(F.col("c.x"), F.col("c.y"), x0, y0, gsd)
    sample = known.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.round("p", 4).alias("confidence"), F.round(F.coalesce("height", F.lit(0.0)), 2).alias("height"))
    found = placed.withColumns({"row": row, "col": col}).join(sample, ["row", "col"], "left")
    return found.select("region", "rings", polygon_area(F.col("rings")).alias("area"), "confidence", "height")


def roads(pixels: DataFrame, x0: float = 0.0, y0: float = 0.0, gsd: float = 1.0, threshold: float = 0.45, least: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Centre lines, surfaces and graph of roads from ``row, col, p``.

    The mask is closed and thinned; lines between ends and junctions of at least a length stay, with the mean
    width along them: ``line, points, length, width``. Surfaces are the lines widened, with flat ends:
    ``line, rings, area``. Edges of the graph join the lines' rounded ends: ``p, q, weight, line``.
    """
    mask = written(erode(dilate(pixels.select("row", "col", (F.col("p") >= threshold).cast("int").alias("v")))))
    inside = written(distance_transform(mask.select("row", "col", (F.col("v") == 1).alias("inside"))).where("inside").select("row", "col", F.coalesce("distance", F.lit(1.0)).alias("distance")))
    skeleton = thin(inside.select("row", "col")).join(inside, ["row", "col"])
    lines = written(center_lines(skeleton, "distance", least, gsd, x0, y0))
    surfaces = lines_buffered(lines, "line", "points", F.col("width") / 2).select(F.col("shape").alias("line"), "rings", "area")
    first, last = F.get("points", F.lit(0)), F.get("points", F.size("points") - 1)
    ends = lines.select("line", first["x"].alias("ax"), first["y"].alias("ay"), last["x"].alias("bx"), last["y"].alias("by"))
    edges = graph_edges(ends).drop("weight").join(lines.select("line", F.col("length").alias("weight")), "line").select("p", "q", "weight", "line")
    return lines, surfaces, edges


def delineated(
    lines: DataFrame, cell: float, road_surfaces: DataFrame | None = None, buildings: DataFrame | None = None, least_area: float = 5.0,
    sliver_area: float = 15.0, sliver_compactness: float = 0.05, road_share: float = 0.5,
) -> DataFrame:
    """``parcel, rings, area, perimeter, compactness, buildings, confidence, needs_gt``: parcels from boundary lines ``line, ax, ay, bx, by``.

    Lines are noded and closed to faces, islands cut out. Faces under ``least_area`` and those that roads (``line,
    rings``) cover by more than ``road_share`` go. Slivers, small or not compact, join the face with which they share
    the longest border; one without a neighbour stays if it is large enough, and where all are slivers all stay.
    ``buildings`` (``id, rings``) count for the parcel that holds them whole.
    """
    faces = written(face_polygons(noded(lines, cell), cell, least_area).withColumn("b", ring_bounds(F.get("rings", F.lit(0)))).select("face", "rings", "area", "perimeter", "b.*"))
    if road_surfaces is not None:
        boxed = road_surfaces.select(F.col("line").alias("road"), "rings", ring_bounds(F.get("rings", F.lit(0))).alias("b")).select("road", "rings", "b.*")
        # All roads that meet a face are dissolved first, so that where they cross counts once.
        met = written(meeting_pairs(faces, boxed, cell).select(F.col("a_face").alias("face"), F.col("b_rings").alias("rings")))
        surface = written(dissolved(met, "face", "rings").select(F.col("shape").alias("face"), F.col("rings").alias("road")))
        both = faces.join(surface.groupBy("face").agg(F.flatten(F.collect_list("road")).alias("road")), "face")
        covered = overlaid(both, "face", "rings", "road", "intersection").groupBy(F.col("shape").alias("face")).agg(F.sum("area").alias("covered"))
        faces = written(faces.join(covered, "face", "left").where(F.coalesce("covered", F.lit(0.0)) <= road_share * F.col("area")).drop("covered"))
    marked = faces.withColumn("sliver", (F.col("area") < sliver_area) | (compactness(F.col("area"), F.col("perimeter")) < sliver_compactness))
    slivers, others = marked.where("sliver"), marked.where("not sliver")
    if others.head(1):
        edge = lambda df, name: df.select(F.col("face").alias(name), F.explode("rings").alias("ring")).select(
            name, F.explode(F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e")
        ).select(name, F.col("e.p").alias("p"), F.col("e.q").alias("q"))
        # Faces of one network share whole pieces, each the other way round.
        border = edge(slivers, "face").join(edge(others, "into").select("into", F.col("p").alias("q"), F.col("q").alias("p")), ["p", "q"])
        shared = border.groupBy("face", "into").agg(F.sum(F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y"))).alias("border"))
        best = written(shared.groupBy("face").agg(F.max_by("into", F.struct("border", -F.col("into"))).alias("into")))
        alone = slivers.join(best, "face", "left_anti").where(F.col("area") >= least_area)
        keyed = others.select(F.col("face").alias("parcel"), "rings").unionByName(alone.select(F.col("face").alias("parcel"), "rings")).unionByName(slivers.join(best, "face").select(F.col("into").alias("parcel"), "rings"))
        found = dissolved(keyed, "parcel", "rings").select(F.col("shape").alias("parcel"), "rings", "area", "perimeter")
    else:
        found = faces.select(F.col("face").alias("parcel"), "rings", "area", "perimeter")
    found = written(found)
    if buildings is None:
        counted = found.withColumn("buildings", F.lit(0).cast("long"))
    else:
        counted = found.join(_held(found, buildings, cell), "parcel", "left").withColumn("buildings", F.coalesce("buildings", F.lit(0)))
    compact = compactness(F.col("area"), F.col("perimeter"))
    sure = F.least(F.lit(0.95), F.greatest(F.lit(0.5), 0.7 * compact + F.when(F.col("buildings") > 0, 0.25).otherwise(0.1)))
    return counted.select(
        "parcel", "rings", F.round("area", 2).alias("area"), F.round("perimeter", 2).alias("perimeter"), F.round(compact, 4).alias("compactness"), "buildings",
        F.round(sure, 4).alias("confidence"), (sure < 0.65).alias("needs_gt"),
    )


def _held(parcels: DataFrame, buildings: DataFrame, cell: float) -> DataFrame:
    """``parcel, buildings``: the buildings that share their whole area with a parcel."""
    boxed = lambda df, key: df.select(key, "rings", ring_bounds(F.get("rings", F.lit(0))).alias("b")).select(key, "rings", "b.*")
    near = meeting_pairs(boxed(parcels, "parcel"), boxed(buildings, "id"), cell, (F.col("b_x0") >= F.col("a_x0")) & (F.col("b_y0") >= F.col("a_y0")) & (F.col("b_x1") <= F.col("a_x1")) & (F.col("b_y1") <= F.col("a_y1")))
    pairs = written(near.withColumn("pair", F.monotonically_increasing_id()))
    shared = overlaid(pairs, "pair", "b_rings", "a_rings", "difference").groupBy(F.col("shape").alias("pair")).agg(F.sum("area").alias("beyond"))
    inside = pairs.join(shared, "pair", "left").where(F.coalesce("beyond", F.lit(0.0)) <= 1e-6)
    return inside.groupBy(F.col("a_parcel").alias("parcel")).agg(F.count("*").alias("buildings"))
