"""Whole ways from rasters to features, on the fixtures of two blocks, a road and a network."""

import pytest
from pyspark.sql import functions as F

from plotline.functions.geometry import ring_contains
from plotline.operators import delineation

RINGS = "array<array<struct<x:double,y:double>>>"

def scene(spark, size=150):
    """Two buildings that touch by a neck, a road, and a speck."""
    def building(r, c):
        return 30 <= r < 70 and 30 <= c < 80 or 30 <= r < 70 and 84 <= c < 120 or 48 <= r < 52 and 80 <= c < 84 or r == 5 and c == 5

    rows = [(r, c, 0.95 if building(r, c) else 0.05, 0.90 if 90 <= r < 110 else 0.02, 7.5 if building(r, c) else 0.0) for r in range(size) for c in range(size)]
    return spark.createDataFrame(rows, "row int, col int, building double, road double, height double")

def test_buildings_leave_the_raster(spark):
    px = scene(spark).select("row", "col", F.col("building").alias("p"), "height").cache()
    found = sorted(delineation.footprints(px, 500000.0, 2000000.0, 0.05, least_area=3.0).collect(), key=lambda r: r["rings"][0][0]["x"])
    assert [(r["confidence"], r["height"], len(r["rings"])) for r in found] == [(0.95, 7.5, 1)] * 2
    # 2.5 by 2 and 1.8 by 2 metres, and a part of the neck each; squared to rectangles.

    assert sum(r["area"] for r in found) == pytest.approx(8.6, abs=0.7) and all(len(r["rings"][0]) <= 8 for r in found)
    centre = px.sparkSession.createDataFrame([(500000 + 55 * 0.05, 2000000 - 50 * 0.05)], "x double, y double")
    rings = spark.createDataFrame([(r["rings"][0],) for r in found], "ring array<struct<x:double,y:double>>")
    assert rings.crossJoin(centre).where(ring_contains(F.col("x"), F.col("y"), F.col("ring"))).count() == 1
    assert delineation.footprints(px.where("row < 25"), 0.0, 0.0, 0.05).count() == 0

def test_roads_leave_the_raster(spark):
    px = scene(spark).select("row", "col", F.col("road").alias("p"))
    lines, surfaces, edges = delineation.roads(px, 500000.0, 2000000.0, 0.05)
    line = lines.collect()
    assert len(line) >= 1 and max(r["length"] for r in line) > 5 and all(0.8 <= r["width"] / 1.0 <= 1.6 for r in line)
    area = {r["line"]: r["area"] for r in surfaces.collect()}
    longest = max(line, key=lambda r: r["length"])
    assert area[longest["line"]] == pytest.approx(longest["length"] * longest["width"], rel=0.15)
    assert edges.count() >= 1 and edges.select(F.explode(F.array("p", "q"))).distinct().count() >= 2

def test_parcels_from_a_network(spark):
    sides = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0), (0, 0, 10, 10)]
    # A strip of a sliver to the right, a face that is a road to the left, and a loose end.
    sides += [(10, 0, 10.5, 0), (10.5, 0, 10.5, 10), (10.5, 10, 10, 10), (0, 0, -6, 0), (-6, 0, -6, 10), (-6, 10, 0, 10), (5, 5, 6, 4)]
    lines = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(sides)], "line long, ax double, ay double, bx double, by double")
    box = lambda x0, y0, x1, y1: [[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]]
    roads = spark.createDataFrame([(1, box(-6.0, -1.0, -3.0, 11.0)), (2, box(-4.0, -1.0, -2.0, 11.0))], f"line long, rings {RINGS}")
    houses = spark.createDataFrame([(1, box(6.0, 1.0, 8.0, 2.0)), (2, box(4.0, 4.0, 6.0, 6.0)), (3, box(10.1, 4.0, 10.2, 5.0))], f"id long, rings {RINGS}")
    found = sorted((r["area"], r["buildings"], r["needs_gt"], len(r["rings"])) for r in delineation.delineated(lines, 5.0, roads, houses).collect())
    # The lower triangle takes the sliver and the house inside it; the left face is road by two thirds.
    assert found == [(50.0, 0, True, 1), (55.0, 2, False, 1)] or found == [(50.0, 0, True, 1), (55.0, 2, True, 1)]
    plain = sorted((r["area"], r["compactness"], r["confidence"]) for r in delineation.delineated(lines.where("line < 5"), 5.0).collect())
    assert plain == [(50.0, 0.539, 0.5), (50.0, 0.539, 0.5)]
    small = delineation.delineated(lines.where("line < 5"), 5.0, sliver_area=60.0)
    assert small.count() == 2 and delineation.delineated(lines.where("line = 11"), 5.0).count() == 0
