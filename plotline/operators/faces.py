"""Faces of a noded line network, and slivers among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.geometry import box_area, box_ring, shared_area
from plotline.operators.arrangement import as_rows, dissolved, probes, smallest_around, stitched
from plotline.operators.checkpoints import written
from plotline.operators.components import connected_components
from plotline.operators.spatial_join import meeting_pairs
from plotline.operators.validation import marked_slivers, sliver_pairs


def half_edges(pieces: DataFrame, digits: int = 6) -> DataFrame:
    """Both directions of every edge: ``edge, u, v, twin, next``; nodes are rounded end points.

    Around a node the edges that leave it are sorted by angle; an edge goes on with the one that comes
    before its twin there, which keeps the face on the left.
    """
    at = lambda a, b: F.struct((F.round(F.col(a), digits) + 0.0).alias("x"), (F.round(F.col(b), digits) + 0.0).alias("y"))
    ends = pieces.select(at("ax", "ay").alias("u"), at("bx", "by").alias("v")).where("u <> v")
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    known = written(both.withColumn("edge", F.monotonically_increasing_id()))
    around = Window.partitionBy("u").orderBy(F.atan2(F.col("v.y") - F.col("u.y"), F.col("v.x") - F.col("u.x")), "edge")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("edge").over(around), F.last("edge").over(whole))
    turned = known.withColumn("before", before).select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("edge").alias("twin"), F.col("before").alias("next"))
    return known.join(turned, ["u", "v"])


def _faced(pieces: DataFrame, digits: int) -> DataFrame:
    """Half edges with the ``face`` on their left, and whether they bound it: ``bounds`` is false where it lies on both sides."""
    edges = written(half_edges(pieces, digits))
    cycles = connected_components(edges.select(F.col("edge").alias("src"), F.col("next").alias("dst")), cut=written)
    placed = edges.join(cycles.withColumnsRenamed({"node": "edge", "component": "face"}), "edge")
    other = placed.select(F.col("edge").alias("twin"), F.col("face").alias("beyond"))
    return placed.join(other, "twin").withColumn("bounds", F.col("face") != F.col("beyond"))


def polygonised(pieces: DataFrame, least_area: float = 0.0, digits: int = 6) -> DataFrame:
    """Bounded faces of noded segments ``ax, ay, bx, by``: ``face, area, perimeter, edges, x0, y0, x1, y1``.

    A face is a cycle of half edges, found as a component of each edge with its next one; its area is a sum
    over its edges, so no ring is gathered in one place. Edges with the same face on both sides, such as
    dead ends, bound nothing and count nowhere. A face that lies within another as an island is a face and
    not cut out of the outer one; ``face_polygons`` cuts it out.
    """
    sided = _faced(pieces, digits)
    ux, uy, vx, vy = (F.col(c) for c in ("u.x", "u.y", "v.x", "v.y"))
    length = F.when(F.col("bounds"), F.hypot(vx - ux, vy - uy)).otherwise(0.0)
    corner = lambda f, c: f(F.when(F.col("bounds"), F.col(c)))
    found = sided.groupBy("face").agg(
        (F.sum((ux - vx) * (uy + vy)) / 2).alias("area"), F.sum(length).alias("perimeter"), F.count(F.when(F.col("bounds"), 1)).alias("edges"),
        corner(F.min, "u.x").alias("x0"), corner(F.min, "u.y").alias("y0"), corner(F.max, "u.x").alias("x1"), corner(F.max, "u.y").alias("y1"),
    )
    return found.where((F.col("area") > 0) & (F.col("area") >= least_area) & (F.col("edges") > 0))


def face_polygons(pieces: DataFrame, cell: float, least_area: float = 0.0, digits: int = 6) -> DataFrame:
    """``face, rings, area, perimeter``: the faces of noded segments as polygons, islands cut out of the face around them.

    Edges that bound a face are stitched to rings. The outline of a part of the network that hangs together
    is the hole of the smallest face around it, whose bounds it finds by grid cells of width ``cell``.
    """
    sided = _faced(pieces, digits).where("bounds")
    rings = written(stitched(sided.select(F.col("face").alias("shape"), F.col("u.x").alias("ax"), F.col("u.y").alias("ay"), F.col("v.x").alias("bx"), F.col("v.y").alias("by"))))
    shells, holes = rings.where("area > 0"), rings.where("area < 0")
    bounds = shells.groupBy("ring").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    probed = probes(holes).drop("shape")
    spots = probed.withColumns({"x0": F.col("px"), "y0": F.col("py"), "x1": F.col("px"), "y1": F.col("py")})
    near = meeting_pairs(spots, bounds, cell).select(*[F.col(f"a_{c}").alias(c) for c in probed.columns], F.col("b_ring").alias("ring"))
    under = smallest_around(near.join(shells, "ring")).withColumnRenamed("hole", "ring")
    owner = shells.select("ring", "shape").distinct().withColumnsRenamed({"ring": "part", "shape": "owner"})
    inside = holes.join(under, "ring").join(owner, "part").withColumn("shape", F.col("owner")).select(*rings.columns, "part")
    whole = as_rows(shells.withColumn("part", F.col("ring")).unionByName(inside))
    return whole.where(F.col("area") >= least_area).select(F.col("shape").alias("face"), "rings", "area", "perimeter")


def merged_slivers(parcels: DataFrame, sliver_area: float = 15.0, sliver_compactness: float = 0.05, least_area: float = 5.0) -> DataFrame:
    """``id, area, members``: faces with the slivers that join them, by the longest shared border.

    A sliver without a neighbour stays if it has ``least_area`` or more. Where all faces are slivers, all
    stay as they are. Neighbours are those of the original faces, so that no order matters. ``members``
    are the ids of a face and its slivers, in order; an overlap with a sliver counts once.
    """
    marked = marked_slivers(parcels, sliver_area, sliver_compactness)
    some = marked.agg(F.coalesce(F.bool_or(~F.col("sliver")), F.lit(False)).alias("some")).withColumn("one", F.lit(1))
    joins = sliver_pairs(marked).withColumn("gained", box_area("a_") - shared_area("a_", "b_"))
    best = joins.groupBy(F.col("a_id").alias("id")).agg(F.max_by(F.struct(F.col("b_id").alias("into"), "gained"), F.struct("border", -F.col("b_id"))).alias("best"))
    gained = best.groupBy(F.col("best.into").alias("id")).agg(F.sum("best.gained").alias("gained"), F.collect_list("id").alias("slivers"))
    alone = marked.where("sliver").join(best, "id", "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(some), "one")
    lone = alone.where((box_area() >= least_area) | ~F.col("some")).select("id", box_area().alias("area"), F.array("id").alias("members"))
    faces = marked.where("not sliver").join(gained, "id", "left").select(
        "id", (box_area() + F.coalesce("gained", F.lit(0.0))).alias("area"), F.array_sort(F.concat(F.array("id"), F.coalesce("slivers", F.array().cast("array<long>")))).alias("members")
    )
    return faces.unionByName(lone)


def merged_sliver_polygons(parcels: DataFrame, sliver_area: float = 15.0, sliver_compactness: float = 0.05, least_area: float = 5.0) -> DataFrame:
    """``id, part, rings, area, perimeter, members``: the faces of ``merged_slivers`` as dissolved polygons.

    A face and its slivers meet, so that they give one part unless they do at a corner only.
    """
    merged = written(merged_slivers(parcels, sliver_area, sliver_compactness, least_area).select("id", "members"))
    boxes = parcels.select(F.col("id").alias("member"), F.array(box_ring()).alias("rings"))
    joined = merged.select("id", F.explode("members").alias("member")).join(boxes, "member")
    return dissolved(joined, "id", "rings").withColumnRenamed("shape", "id").join(merged, "id")
