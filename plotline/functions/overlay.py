"""Measures of rings that column expressions can't give, as Arrow-batched functions of small rings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# As types and not as text, which needs a session to be read.
POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
RING = ArrayType(POINT)
RECTANGLE = StructType([StructField(c, DoubleType()) for c in ("short", "long", "angle")])


def _points(ring) -> list[tuple[float, float]]:
    """Vertices of a ring; a last one equal to the first is left out."""
    found = [(p["x"], p["y"]) for p in (ring if ring is not None else ())]
    return found[:-1] if len(found) > 1 and found[0] == found[-1] else found


def _area(points: list[tuple[float, float]]) -> float:
    """Signed area, positive counter-clockwise."""
    return sum((x - u) * (y + v) for (x, y), (u, v) in zip(points, points[1:] + points[:1], strict=True)) / 2


def _triangles(points):
    """Triangles from the first vertex, counter-clockwise, each with its sign in the ring's area."""
    for p, q in zip(points[1:], points[2:]):
        if area := _area([points[0], p, q]):
            yield ([points[0], p, q] if area > 0 else [points[0], q, p]), math.copysign(1.0, area)


def _clipped(points, triangle) -> float:
    """Area of a convex polygon inside a triangle, clipped by one edge after the other."""
    for (ax, ay), (bx, by) in zip(triangle, triangle[1:] + triangle[:1], strict=True):
        kept, side = [], [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in points]
        for k, (p, d) in enumerate(zip(points, side, strict=True)):
            (qx, qy), e = points[k - 1], side[k - 1]
            if (d < 0) != (e < 0):
                t = e / (e - d)
                kept.append((qx + t * (p[0] - qx), qy + t * (p[1] - qy)))
            if d >= 0:
                kept.append(p)
        points = kept
        if len(points) < 3:
            return 0.0
    return abs(_area(points))


def shared(a, b) -> float:
    """Area of the intersection of two simple rings, convex or not, as a signed sum over their triangles."""
    first, second = _points(a), _points(b)
    total = sum(s * r * _clipped(t, u) for t, s in _triangles(first) for u, r in _triangles(second))
    return abs(total) if (_area(first) > 0) == (_area(second) > 0) else abs(-total)


@F.pandas_udf(DoubleType())
def ring_shared_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Area that two rings share; null where either is null."""
    return pd.Series([None if x is None or y is None else shared(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, by monotone chains."""
    def half(ordered):
        chain: list = []
        for p in ordered:
            while len(chain) > 1 and _area([chain[-2], chain[-1], p]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    ordered = sorted(set(points))
    return ordered if len(ordered) < 3 else half(ordered) + half(ordered[::-1])


def oriented_rectangle(ring) -> tuple[float, float, float] | None:
    """Shorter and longer side of the smallest turned rectangle around a ring, and the longer one's angle in degrees, 0 to 180."""
    hull = _hull(_points(ring))
    if len(hull) < 3:
        return None
    points, best = np.array(hull), None
    for (x, y), (u, v) in zip(hull, hull[1:] + hull[:1], strict=True):
        turn = math.atan2(v - y, u - x)
        c, s = math.cos(turn), math.sin(turn)
        width, height = np.ptp(points @ np.array([[c, -s], [s, c]]), axis=0)
        if best is None or width * height < best[0] - 1e-12:
            best = (width * height, min(width, height), max(width, height), math.degrees(turn + (math.pi / 2 if height > width else 0)) % 180.0)
    return float(best[1]), float(best[2]), float(best[3])


@F.pandas_udf(RECTANGLE)
def ring_rectangle(ring: pd.Series) -> pd.DataFrame:
    """``short, long, angle`` of the smallest turned rectangle; null for a ring without area."""
    rows = [oriented_rectangle(r) or (None,) * 3 for r in ring]
    return pd.DataFrame(rows, columns=["short", "long", "angle"], dtype="float64")


def _far(points, first: int, last: int, tolerance: float, kept: set[int]) -> None:
    """Keep the vertex farthest from a chord while it is beyond the tolerance, on both sides of it in turn."""
    todo = [(first, last)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, b = points[i], points[j % len(points)]
        d, inner = b - a, points[i + 1 : j] - a
        along = np.clip(inner @ d / (d @ d), 0, 1) if d @ d else np.zeros(len(inner))
        away = np.hypot(*(inner - along[:, None] * d).T)
        k = int(away.argmax())
        if away[k] > tolerance:
            kept.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]


def simplified(ring, tolerance: float) -> list[dict]:
    """A ring without vertices closer than the tolerance to the line of their neighbours (Douglas and Peucker, 1973); as it was if fewer than 3 would stay."""
    points = np.array(_points(ring), dtype=float).reshape(-1, 2)
    if len(points) < 4:
        return [{"x": x, "y": y} for x, y in points.tolist()]
    opposite = int(np.hypot(*(points - points[0]).T).argmax())
    kept = {0, opposite}
    _far(points, 0, opposite, tolerance, kept)
    _far(points, opposite, len(points), tolerance, kept)
    chosen = points[sorted(kept)] if len(kept) > 2 else points
    return [{"x": x, "y": y} for x, y in chosen.tolist()]


def ring_simplified(ring, tolerance: float):
    """The ring column simplified with a tolerance."""
    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else simplified(r, tolerance) for r in rings], dtype=object)

    return run(ring)


def orthogonal(ring, least_iou: float = 0.88, least_area: float = 1.0) -> list[dict]:
    """The rectangle that stands for a nearly rectangular ring, or the ring itself.

    The ring is turned back by its main direction about its centroid, its bounds are taken, and these are
    turned forth about their own centre. The result stands if it shares ``least_iou`` with the ring.
    """
    points = _points(ring)
    same = [{"x": x, "y": y} for x, y in points]
    rectangle, area = oriented_rectangle(ring), abs(_area(points)) if points else 0.0
    if rectangle is None or area < least_area:
        return same
    turn = math.radians(rectangle[2])
    # From the first vertex, as products of map coordinates lose the digits of a small ring.
    ox, oy = points[0]
    points = [(x - ox, y - oy) for x, y in points]
    crosses = [(x * v - u * y, x + u, y + v) for (x, y), (u, v) in zip(points, points[1:] + points[:1], strict=True)]
    total = sum(c for c, _, _ in crosses)
    centre = np.array([sum(c * s for c, s, _ in crosses), sum(c * s for c, _, s in crosses)]) / (3 * total)
    c, s = math.cos(turn), math.sin(turn)
    back = (np.array(points) - centre) @ np.array([[c, -s], [s, c]]) + centre
    (x0, y0), (x1, y1) = back.min(axis=0), back.max(axis=0)
    corners, middle = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]), np.array([(x0 + x1) / 2, (y0 + y1) / 2])
    made = [{"x": x + ox, "y": y + oy} for x, y in ((corners - middle) @ np.array([[c, s], [-s, c]]) + middle).tolist()]
    both = shared(made, same)
    return made if both >= least_iou * ((x1 - x0) * (y1 - y0) + area - both) else same


@F.pandas_udf(RING)
def ring_orthogonal(ring: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else orthogonal(r) for r in ring], dtype=object)
