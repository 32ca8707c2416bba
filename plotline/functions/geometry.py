"""Measures of boxes and of rings of vertices, as column expressions.

A box is four columns ``x0, y0, x1, y1`` (with an optional prefix). A ring is an array of (x, y) structs,
closed or not; holes are further rings. Expressions stay in generated code: no Python runs per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in BOX)


def box_area(prefix: str = "") -> Column:
    x0, y0, x1, y1 = box(prefix)
    return (x1 - x0) * (y1 - y0)


def box_perimeter(prefix: str = "") -> Column:
    x0, y0, x1, y1 = box(prefix)
    return 2.0 * ((x1 - x0) + (y1 - y0))


def shared_area(a: str, b: str) -> Column:
    """Area of the intersection of two boxes; extents are clamped, so boxes apart share 0."""
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    clamp = lambda low, high: F.greatest(F.least(*high) - F.greatest(*low), F.lit(0.0))
    return clamp((ax0, bx0), (ax1, bx1)) * clamp((ay0, by0), (ay1, by1))


def iou_above(a: str, b: str, threshold: float) -> Column:
    """Intersection over union above a threshold, without a division."""
    shared = shared_area(a, b)
    return shared > threshold * (box_area(a) + box_area(b) - shared)


def iou(a: str, b: str) -> Column:
    """Intersection over union; null where the union is empty."""
    shared = shared_area(a, b)
    return F.try_divide(shared, box_area(a) + box_area(b) - shared)


def boxes_meet(a: str, b: str) -> Column:
    """Whether boxes share a point, borders included."""
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def box_contains(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = box(a)
    bx0, by0, bx1, by1 = box(b)
    return (ax0 <= bx0) & (ay0 <= by0) & (bx1 <= ax1) & (by1 <= ay1)


def aspect(width: Column, height: Column) -> Column:
    """Longer over shorter side; null where the shorter is 0."""
    return F.try_divide(F.greatest(width, height), F.least(width, height))


def compactness(area: Column, perimeter: Column) -> Column:
    """Polsby-Popper: 4 pi area / perimeter squared, 0 for no perimeter."""
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(0.0)


def box_boundary_distance(x: Column, y: Column, prefix: str = "") -> Column:
    """Distance of a point to a box's boundary, from inside or outside."""
    x0, y0, x1, y1 = box(prefix)
    inside = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
    return F.when(inside, F.least(x - x0, x1 - x, y - y0, y1 - y)).otherwise(box_distance(x, y, prefix))


def box_distance(x: Column, y: Column, prefix: str = "", of: Column | None = None) -> Column:
    """Distance of a point to a box, 0 inside; the box's columns are fields of ``of`` if it is given."""
    x0, y0, x1, y1 = box(prefix) if of is None else (of[prefix + c] for c in BOX)
    dx = F.greatest(x0 - x, x - x1, F.lit(0.0))
    dy = F.greatest(y0 - y, y - y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def _edges(ring: Column) -> Column:
    """(x, y, next x, next y) of a ring, closed by its first vertex."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v")))


def ring_area(ring: Column) -> Column:
    """Area by the shoelace formula, without sign."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["x"] - e["u"]) * (e["y"] + e["v"]))) / 2.0


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less that of the others, its holes."""
    areas = F.transform(rings, ring_area)
    return F.coalesce(2.0 * F.get(areas, F.lit(0)) - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a), F.lit(0.0))


def ring_length(ring: Column) -> Column:
    """Length of a closed ring."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["u"] - e["x"], e["v"] - e["y"]))


def ring_centroid(ring: Column) -> Column:
    """Centroid (x, y) weighted by area; null for a ring without area.

    Sums are taken from the first vertex, as products of map coordinates lose the digits of a small ring.
    """
    origin = F.get(ring, F.lit(0))
    edges = _edges(F.transform(ring, lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y"))))
    cross = lambda e: e["x"] * e["v"] - e["u"] * e["y"]
    total = F.aggregate(edges, F.lit(0.0), lambda s, e: s + cross(e))
    sx = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["x"] + e["u"]) * cross(e))
    sy = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["y"] + e["v"]) * cross(e))
    return F.struct((origin["x"] + F.try_divide(sx, 3.0 * total)).alias("x"), (origin["y"] + F.try_divide(sy, 3.0 * total)).alias("y"))


def ring_bounds(ring: Column) -> Column:
    pick = lambda c: F.transform(ring, lambda p: p[c])
    return F.struct(F.array_min(pick("x")).alias("x0"), F.array_min(pick("y")).alias("y0"), F.array_max(pick("x")).alias("x1"), F.array_max(pick("y")).alias("y1"))


def rotated(ring: Column, radians: Column, about: Column) -> Column:
    """The ring turned about a point."""
    c, s = F.cos(radians), F.sin(radians)
    return F.transform(ring, lambda p: F.struct(
        (about["x"] + (p["x"] - about["x"]) * c - (p["y"] - about["y"]) * s).alias("x"),
        (about["y"] + (p["x"] - about["x"]) * s + (p["y"] - about["y"]) * c).alias("y"),
    ))


def ring_boundary_distance(x: Column, y: Column, ring: Column) -> Column:
    """Smallest distance of a point to the ring's segments."""
    def distance(e: Column) -> Column:
        dx, dy = e["u"] - e["x"], e["v"] - e["y"]
        along = F.coalesce(F.try_divide((x - e["x"]) * dx + (y - e["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(x - e["x"] - t * dx, y - e["y"] - t * dy)

    return F.array_min(F.transform(_edges(ring), distance))


def ring_contains(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside the ring, by the even-odd rule."""
    crossing = lambda e: ((e["y"] > y) != (e["v"] > y)) & (x < e["x"] + F.try_divide((y - e["y"]) * (e["u"] - e["x"]), e["v"] - e["y"]))
    return F.size(F.filter(_edges(ring), crossing)) % 2 == 1


def box_ring(prefix: str = "") -> Column:
    """A box as a ring of four vertices."""
    x0, y0, x1, y1 = box(prefix)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1))
