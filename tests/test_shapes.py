"""Polygons in any position, vectorised rasters, lines and chips, against brute force and fixtures."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.operators import arrangement, augmentation, burning, faces, healing, network, polygon_rules, raster, tracing, vectorise, watershed
from plotline.operators.ranking import ranked

RINGS = "array<array<struct<x:double,y:double>>>"
SIDE = 1 << 32


def shape(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def inside(rings, x, y):
    """Even-odd rule over all rings."""
    edges = [(p, q) for r in rings for p, q in zip(r, r[1:] + r[:1])]
    return sum((p["y"] > y) != (q["y"] > y) and x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]) for p, q in edges) % 2 == 1


def by_shape(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["shape"], []).append(r)
    return found


def is_simple(ring):
    return len({(p["x"], p["y"]) for p in ring}) == len(ring)


def test_ranks_of_chains_and_rings(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 400)
    rows, want, at = [], set(), 0
    for length, ring in [(1, False), (1, True), (2, True), (7, False), (64, True), (65, True), (90, False), (33, True), (40, False)]:
        own = names[at : at + length]
        at += length
        rows += list(zip(own, own[1:] + [own[0] if ring else None]))
        first = own.index(min(own)) if ring else 0
        turned = own[first:] + own[:first]
        want |= {(n, min(own) if ring else own[-1], k, ring) for k, n in enumerate(turned)}
    links = spark.createDataFrame(rows, "link long, next long").repartition(5)
    assert {tuple(r) for r in ranked(links).select("link", "chain", "seq", "ring").collect()} == want
    assert ranked(links.where("false")).count() == 0


def test_regions_become_simple_polygons(spark):
    rng = random.Random(1)
    cells = {(i, j): rng.choice((1, 1, 1, 2, None)) for i in range(16) for j in range(18)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "row int, col int, label int")
    pixels = vectorise.regions(df).cache()
    region = {(r["row"], r["col"]): r["region"] for r in pixels.collect()}
    assert set(region) == {p for p, v in cells.items() if v is not None}
    for (i, j), v in cells.items():
        for q in ((i + 1, j), (i, j + 1)):
            if v is not None and cells.get(q) is not None:
                assert (region[i, j] == region[q]) >= (v == cells[q]) and (v == cells[q] or region[i, j] != region[q])
    found = vectorise.polygons(vectorise.ring_corners(pixels), 100.0, 50.0, 0.5).collect()
    assert {r["region"] for r in found} == set(region.values())
    for r in found:
        own = {p for p, k in region.items() if k == r["region"]}
        rings = [[{"x": p["x"], "y": p["y"]} for p in ring] for ring in r["rings"]]
        assert r["area"] == len(own) / 4 and all(map(is_simple, rings)) and len(rings) == r["holes"] + 1
        assert all(inside(rings, 100 + (j + 0.5) / 2, 50 - (i + 0.5) / 2) == ((i, j) in own) for i in range(16) for j in range(18))
    assert vectorise.polygons(vectorise.ring_corners(vectorise.regions(df.where("false")))).count() == 0


def test_a_hole_that_touches_the_outline_is_a_ring(spark):
    art = ["####", "#.##", "##.#", "###."]
    cells = [(i, j, 1) for i, line in enumerate(art) for j, c in enumerate(line) if c == "#"]
    df = spark.createDataFrame(cells, "row int, col int, label int")
    r = vectorise.polygons(vectorise.ring_corners(vectorise.regions(df))).first()
    # The open corner below is no hole; the two pixels inside touch it and each other at corners.
    assert r["area"] == 13 and r["holes"] == 2 and sorted(map(len, r["rings"])) == [4, 4, 6]


def test_repair_of_invalid_rings(spark):
    rows = [
        (1, shape([(0, 0), (0, 2), (2, 0), (2, 2)])), (2, shape(square(0, 0, 4))), (3, shape([(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4)])),
        (4, shape(square(0, 0, 10), [(0, 5), (5, 2), (5, 8)])), (5, shape([(0, 0), (1, 1), (2, 2)])), (6, None), (7, shape(square(0, 0, 10), square(2, 2, 3), square(3, 3, 1))),
        (8, shape([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])), (9, []), (10, shape([(0, 0), (float("nan"), 1), (4, 0), (4, 4)])),
    ]
    found = by_shape(arrangement.made_valid(spark.createDataFrame(rows, f"id long, rings {RINGS}"), "id", "rings"))
    areas = {k: sorted(round(r["area"], 6) for r in v) for k, v in found.items()}
    assert areas == {1: [1.0, 1.0], 2: [16.0], 3: [16.0], 4: [85.0], 7: [1.0, 91.0], 8: [16.0], 10: [8.0]}
    assert [len(r["rings"]) for r in found[4]] == [2] and sorted(len(r["rings"]) for r in found[7]) == [1, 2]
    assert all(is_simple(ring) for v in found.values() for r in v for ring in r["rings"])
    assert {frozenset((p["x"], p["y"]) for p in r["rings"][0]) for r in found[1]} == {frozenset({(0, 0), (0, 2), (1, 1)}), frozenset({(2, 0), (2, 2), (1, 1)})}


def test_overlay_equals_the_rule_at_points(spark):
    rng = random.Random(4)

    def star(n, cx, cy):
        return [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in sorted(rng.uniform(0, 6.28) for _ in range(n)) for r in [rng.uniform(1, 6)]]

    rows = [(i, shape(star(9, 0, 0)), shape(star(7, 2, 1), star(4, 2, 1))) for i in range(12)]
    rows += [(100, shape(square(0, 0, 10)), shape(square(2, 2, 3))), (101, shape(square(0, 0, 2)), shape(square(2, 0, 2))), (102, shape(square(0, 0, 2)), shape(square(2, 2, 2))), (103, shape(square(0, 0, 2)), shape(square(0, 0, 2))), (104, shape(square(0, 0, 1)), None)]
    pairs = spark.createDataFrame(rows, f"id long, a {RINGS}, b {RINGS}").cache()
    rules = {"union": lambda a, b: a or b, "intersection": lambda a, b: a and b, "difference": lambda a, b: a and not b, "symmetric": lambda a, b: a != b}
    for how, rule in rules.items():
        found = by_shape(arrangement.overlaid(pairs, "id", "a", "b", how))
        for i, a, b in rows[:12]:
            parts = [[[{"x": p["x"], "y": p["y"]} for p in ring] for ring in r["rings"]] for r in found.get(i, [])]
            assert all(is_simple(ring) for rings in parts for ring in rings)
            for _ in range(150):
                x, y = rng.uniform(-6, 8), rng.uniform(-6, 7)
                assert sum(inside(rings, x, y) for rings in parts) == rule(inside(a, x, y), inside(b, x, y)), (how, i, x, y)
        areas = {k: [len(r["rings"]) for r in v] + [round(sum(r["area"] for r in v), 6)] for k, v in found.items() if k >= 100}
        assert areas == {
            "union": {100: [1, 100.0], 101: [1, 8.0], 102: [1, 1, 8.0], 103: [1, 4.0], 104: [1, 1.0]}, "intersection": {100: [1, 9.0], 103: [1, 4.0]},
            "difference": {100: [2, 91.0], 101: [1, 4.0], 102: [1, 4.0], 104: [1, 1.0]}, "symmetric": {100: [2, 91.0], 101: [1, 8.0], 102: [1, 1, 8.0], 104: [1, 1.0]},
        }[how]


def test_dissolve_keeps_holes_and_parts(spark):
    ring = [(1, shape(square(0, 0, 6, 2))), (1, shape(square(0, 4, 6, 2))), (1, shape(square(0, 1, 2, 4)[::-1])), (1, shape(square(4, 1, 2, 4))), (1, shape(square(20, 0, 1))), (2, shape(square(0, 0, 3), square(1, 1, 1))), (2, shape(square(0, 0, 3)))]
    found = by_shape(arrangement.dissolved(spark.createDataFrame(ring, f"k long, rings {RINGS}"), "k", "rings"))
    assert sorted((r["area"], len(r["rings"])) for r in found[1]) == [(1.0, 1), (32.0, 2)] and [(r["area"], len(r["rings"])) for r in found[2]] == [(9.0, 1)]


def test_buffers_of_lines(spark):
    lines = [(1, [(0, 0), (10, 0)], 1.0), (2, [(0, 0), (10, 0), (10, 0), (10, 10)], 1.0), (3, square(0, 0, 10) + [(0, 0)], 1.0), (4, [(0, 0), (0, 0)], 1.0), (5, [(0, 0), (5, 0), (0, 0)], 1.0), (6, [(0, 0), (9, 1)], 0.0)]
    df = spark.createDataFrame([(i, shape(p)[0], d) for i, p, d in lines], "id long, p array<struct<x:double,y:double>>, d double")
    found = by_shape(arrangement.lines_buffered(df, "id", "p", F.col("d"), 64))
    areas = {k: round(sum(r["area"] for r in v), 3) for k, v in found.items()}
    assert areas[1] == 20 and areas[2] == pytest.approx(39 + math.pi / 4, abs=1e-3) and set(areas) == {1, 2, 3, 5}
    assert areas[3] == pytest.approx(144 - 4 + math.pi - 64, abs=4e-3) and [len(r["rings"]) for r in found[3]] == [2]
    assert areas[5] == pytest.approx(10 + math.pi / 2 + 0, abs=4e-3) or areas[5] == pytest.approx(10 + math.pi, abs=8e-3)


def segments(spark, lines):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(lines)], "line long, ax double, ay double, bx double, by double")


def sides(x, y, w):
    corners = square(x, y, w)
    return [(*p, *q) for p, q in zip(corners, corners[1:] + corners[:1])]


def test_faces_with_islands_and_lines_that_overlap(spark):
    def found(lines):
        made = faces.face_polygons(network.noded(segments(spark, lines), 5.0), 5.0).collect()
        return sorted((round(r["area"], 6), len(r["rings"])) for r in made)

    assert found(sides(0, 0, 10) + sides(3, 3, 3) + sides(4, 4, 1)) == [(1.0, 1), (8.0, 2), (91.0, 2)]
    # Two pieces of the bottom line overlap; a diagonal and a dead end.
    assert found([(0, 0, 6, 0), (4, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0), (0, 0, 10, 10), (5, 5, 6, 4)]) == [(50.0, 1), (50.0, 1)]
    # A triangle that touches the corner inside, and a square that touches another corner outside.
    assert found(sides(0, 0, 10) + [(0, 0, 4, 2), (4, 2, 2, 4), (2, 4, 0, 0)] + sides(10, 10, 5)) == [(6.0, 1), (25.0, 1), (94.0, 2)]
    assert found([(0, 0, 5, 5)]) == []


def test_healing_of_polygons(spark):
    """A figure of eight, two parcels of which the better one keeps the overlap, one wholly covered."""
    rows = [(1, shape([(0, 0), (0, 10), (10, 0), (10, 10)]), 0.5), (2, shape(square(10, 0, 10)), 0.95), (3, shape(square(18, 0, 10)), 0.6), (4, shape(square(50, 0, 10)), 0.9), (5, shape(square(52, 2, 3)), 0.1), (6, shape(square(80, 0, 10), square(82, 2, 6)), None), (7, shape(square(83, 3, 2)), 0.9)]
    fixed = healing.repaired(spark.createDataFrame(rows, f"id long, rings {RINGS}, conf double"))
    assert fixed.where("id = 1").count() == 2
    found = {}
    for r in healing.healed_overlaps(fixed.select("id", "rings", "conf"), 20.0).collect():
        found.setdefault(r["id"], []).append((round(r["area"], 6), r["clips"], len(r["rings"])))
    assert found == {1: [(25.0, 0, 1)] * 2, 2: [(100.0, 0, 1)], 3: [(80.0, 1, 1)], 4: [(100.0, 0, 1)], 5: [(9.0, 1, 1)], 6: [(64.0, 0, 2)], 7: [(4.0, 0, 1)]}


def test_reasons_for_polygons_that_are_not_valid(spark):
    """One polygon per reason, and valid ones that look alike: touching holes, closed rings, repeated vertices."""
    nan, diamond = float("nan"), [(0, 5), (5, 0), (10, 5), (5, 10)]
    cases = [
        (None, None), ([], None), (shape([]), None), (shape(square(0, 0, 4)), None), (shape([(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), None),
        (shape([(0, 0), (nan, 1), (4, 4)]), None), (shape([(0, 0), (float("inf"), 1), (4, 4)]), None), (shape([(0, 0), (4, 4), (0, 0)]), None), (shape(square(0, 0, 4), [(1, 1), (2, 2)]), None),
        (shape([(0, 0), (0, 2), (2, 0), (2, 2)]), (1, 1)), (shape([(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4)]), (2, 4)), (shape([(0, 0), (1, 1), (2, 2)]), (1, 1)),
        (shape([(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)]), (2, 2)), (shape(square(0, 0, 10), [(0, 5), (5, 2), (5, 8)]), None), (shape(square(0, 0, 10), square(2, 2, 3), square(6, 6, 2)), None),
        (shape(square(0, 0, 10), square(2, 2, 3), square(3, 3, 1)), (3, 3)), (shape(square(0, 0, 10), square(20, 0, 3)), (20, 0)), (shape(square(0, 0, 10), square(8, 2, 4)), (10, 2)),
        (shape(square(0, 0, 10), square(7, 2, 3)), (7, 2)), (shape(square(0, 0, 10), diamond), (0, 5)), (shape(square(0, 0, 10), square(2, 2, 2), square(4, 4, 2)), None),
        (shape(square(0, 0, 10), [(0, 5), (5, 2), (5, 5)], [(5, 5), (10, 5), (5, 8)]), (0, 5)), (shape(square(0, 0, 10), []), None),
    ]
    rows = [(i, rings) for i, (rings, _) in enumerate(cases)]
    found = {r["id"]: r for r in polygon_rules.faults(spark.createDataFrame(rows, f"id long, rings {RINGS}")).collect()}
    none, number, few, meets, over, apart = polygon_rules.FAULTS
    assert {k: r["fault"] for k, r in found.items()} == {0: none, 1: none, 2: none, 5: number, 6: number, 7: few, 8: few, 9: meets, 10: meets, 11: meets, 12: meets, 15: over, 16: over, 17: over, 18: over, 19: apart, 21: apart}
    for k, (_, at) in enumerate(cases):
        if at and k != 18:
            assert (found[k]["x"], found[k]["y"]) == at, k
    assert polygon_rules.faults(spark.createDataFrame([], f"id long, rings {RINGS}")).count() == 0


def test_automatic_fixes_of_polygons(spark):
    """A figure of eight over a parcel, a duplicate of lower confidence that overlaps a third parcel, one wholly covered, ones beyond repair."""
    rows = [
        (1, shape([(0, 0), (0, 10), (10, 0), (10, 10)]), 0.5), (2, shape(square(-5, 0, 7, 10)), 0.9), (3, shape(square(100, 0, 10)), 0.4), (4, shape(square(100, 0, 10, 10.1)), 0.8),
        (5, shape(square(109, 0, 10)), 0.6), (6, shape(square(200, 0, 10)), 0.9), (7, shape(square(202, 2, 2)), None), (8, None, 0.5), (9, shape([(0, 0), (1, 1)]), 0.5), (10, shape(square(300, 0, 1)), 0.5),
    ]
    parcels = spark.createDataFrame([(*r, "x") for r in rows], f"id long, rings {RINGS}, conf double, area string")
    fixed, audit = polygon_rules.auto_fixed(parcels, 20.0)
    found = {}
    for r in fixed.collect():
        found.setdefault(r["id"], []).append((round(r["area"], 6), r["clips"]))
    assert {k: sorted(v) for k, v in found.items()} == {1: [(9.0, 1), (25.0, 1)], 2: [(70.0, 0)], 4: [(101.0, 0)], 5: [(90.0, 1)], 6: [(100.0, 0)], 7: [(4.0, 1)], 8: [(0.0, 0)], 9: [(0.0, 0)], 10: [(1.0, 0)]}
    assert {tuple(r) for r in audit.collect()} == {(1, "make_valid", None), (3, "drop_duplicate", None), (1, "clip_overlap", 2), (5, "clip_overlap", 4)}
    issues = {(r["rule"], r["feature_ids"], r["message"]) for r in polygon_rules.polygon_issues(parcels, 20.0).collect()}
    assert issues == {
        (1, "1", "ring meets itself"), (1, "8", "no geometry"), (1, "9", "too few points"), (2, "3,4", "overlap of 100.00 sqm"), (2, "3,5", "overlap of 10.00 sqm"), (2, "4,5", "overlap of 10.00 sqm"),
        (2, "6,7", "overlap of 4.00 sqm"), (3, "3,4", "IoU 0.990"), (4, "10", "area of 1.00 sqm"),
    }
    empty = parcels.where("id < 0")
    assert [x.count() for x in (*polygon_rules.auto_fixed(empty, 20.0), polygon_rules.polygon_issues(empty, 20.0))] == [0, 0, 0]


def test_slivers_merge_to_polygons(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, 0.5), (2, 10.0, 0.0, 10.3, 10.0, 0.5), (3, 10.3, 0.0, 30.0, 10.0, 0.5)]
    p = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, conf double")
    found = {r["id"]: r for r in faces.merged_sliver_polygons(p, 10.0, 0.2).collect()}
    assert found[1]["area"] == pytest.approx(103.0) and found[1]["members"] == [1, 2] and found[3]["area"] == pytest.approx(197.0)
    assert {p["x"] for p in found[1]["rings"][0]} >= {0.0, 10.3}


def number(p):
    return p[0] * SIDE + p[1]


@pytest.mark.parametrize("seed", [2, 3])
def test_flooding_equals_the_forest_of_lowest_passes(spark, seed):
    rng = random.Random(seed)
    relief = {(i, j): rng.choice((0.1, 0.2, round(rng.random(), 3))) for i in range(16) for j in range(18) if rng.random() < 0.75}
    markers = {p: p for p in rng.sample(sorted(relief), 7)}
    rel = spark.createDataFrame([(i, j, v) for (i, j), v in relief.items()], "row int, col int, v double")
    seeds = spark.createDataFrame([(number(p), number(p)) for p in markers], "pixel long, component long")
    got = {(r["row"], r["col"]): r["label"] for r in watershed.flooded(rel, seeds).collect()}
    parent, label = {p: p for p in relief}, {p: number(p) if p in markers else None for p in relief}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    edges = [(max(relief[p], relief[q]), min(relief[p], relief[q]), number(p), number(q), p, q) for p in relief for q in ((p[0], p[1] + 1), (p[0] + 1, p[1])) if q in relief]
    for *_, p, q in sorted(edges):
        a, b = find(p), find(q)
        if a != b and (label[a] is None or label[b] is None):
            parent[b], label[a] = a, label[a] if label[a] is not None else label[b]
    assert got == {p: label[find(p)] for p in relief}


def test_touching_blobs_are_told_apart_as_by_flooding(spark):
    """Two discs with a neck: every pixel off the seam goes where a flood from the peaks takes it."""
    cells = {(i, j) for i in range(24) for j in range(44) if (i - 12) ** 2 + (j - 12) ** 2 <= 90 or (i - 12) ** 2 + (j - 30) ** 2 <= 80}
    cells |= {(2, 40), (2, 41)}
    grid = spark.createDataFrame([(i, j, (i, j) in cells) for i in range(-1, 25) for j in range(-1, 45)], "row int, col int, inside boolean")
    known = raster.distance_transform(grid).where("inside").select("row", "col", "distance").cache()
    found = {(r["row"], r["col"]): r["label"] for r in watershed.instances(known).collect()}
    height = {(r["row"], r["col"]): r["distance"] for r in known.collect()}
    sizes = {}
    for label in found.values():
        sizes[label] = sizes.get(label, 0) + 1
    assert len(sizes) == 3 and sizes[None] == 2 and found[12, 12] != found[12, 30]
    flood, heap, age = {}, [], 0
    for p in ((12, 12), (12, 30)):
        flood[p] = found[p]
        heap.append((-height[p], 0, p))
    while heap:
        _, _, p = heapq.heappop(heap)
        for q in ((p[0] - 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] + 1, p[1])):
            if q in height and q not in flood:
                age += 1
                flood[q] = flood[p]
                heapq.heappush(heap, (-height[q], age, q))
    assert sum(found[p] != label for p, label in flood.items()) <= 0.02 * len(flood)
    one = known.where("col < 20")
    assert watershed.instances(one).select("label").distinct().count() == 1 and watershed.instances(known.where("false")).count() == 0


def walked(pixels):
    """Lines of a skeleton by walking it."""
    def linked(p):
        near = []
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                q = (p[0] + i, p[1] + j)
                if (i or j) and q in pixels and not (i and j and ((p[0] + i, p[1]) in pixels or (p[0], p[1] + j) in pixels)):
                    near.append(q)
        return near

    lines, used = set(), set()
    ends = [p for p in pixels if len(linked(p)) not in (0, 2)]
    for p in ends + sorted(pixels):
        for q in linked(p):
            if (p, q) in used:
                continue
            line = [p, q]
            while len(linked(line[-1])) == 2 and line[-1] != p:
                line.append(next(r for r in linked(line[-1]) if r != line[-2]))
            used |= set(zip(line, line[1:])) | set(zip(line[1:], line))
            lines.add(min(tuple(line), tuple(line[::-1])))
    return lines


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_traced_lines_equal_walking(spark, seed):
    rng = random.Random(seed)
    pixels = {(i, j) for i in range(14) for j in range(16) if rng.random() < (0.2, 0.35, 0.5)[seed - 1]}
    found = {}
    for r in tracing.traced(spark.createDataFrame(sorted(pixels), "row int, col int")).orderBy("line", "seq").collect():
        found.setdefault(r["line"], []).append((r["row"], r["col"]))

    def plain(line):  # a loop without junctions may begin anywhere
        loop = line[0] == line[-1]
        return (loop, tuple(sorted(line[1:])) if loop else min(tuple(line), tuple(line[::-1])))

    assert sorted(map(plain, found.values())) == sorted(map(plain, walked(pixels)))


def test_lines_of_a_loop_and_of_a_corner(spark):
    loop = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]
    df = spark.createDataFrame([(*p, 2.0) for p in loop] + [(20, 20, 0.5), (20, 21, 0.5), (21, 21, 0.5), (30, 30, 1.0)], "row int, col int, distance double")
    found = sorted(tracing.center_lines(df, "distance", 1.0, 0.5, 100.0, 50.0).collect(), key=lambda r: r["line"])
    assert [(len(r["points"]), round(r["length"], 6), r["width"]) for r in found] == [(9, round(2 + 2 * 2**0.5, 6), 2.0), (3, 1.0, 1.5)]
    assert (found[0]["points"][0]["x"], found[0]["points"][0]["y"]) == (100.75, 49.75) and found[0]["points"][0] == found[0]["points"][-1]
    assert tracing.center_lines(df.where("false"), "distance").count() == 0


def test_burned_rings_and_lines(spark):
    rng = random.Random(8)
    rows = [(i, shape([(rng.uniform(-3, 12), rng.uniform(-3, 12)) for _ in range(6)], square(2, 2, 4))) for i in range(15)]
    rows += [(50, shape(square(0.5, 0.5, 3))), (51, shape(square(3.5, 0.5, 2))), (52, shape([(0, 0), (5, 0), (9, 0)])), (53, None)]
    df = spark.createDataFrame(rows, f"id long, rings {RINGS}")
    found = {}
    for r in burning.inside_pixels(df, "id", F.col("rings")).collect():
        found.setdefault(r["id"], set()).add((r["row"], r["col"]))
    for i, rings in rows[:15]:
        assert found.get(i, set()) == {(r, c) for r in range(-5, 14) for c in range(-5, 14) if inside(rings, c + 0.5, r + 0.5)}
    assert found[50] == {(r, c) for r in range(3) for c in range(3)} and found[51] == {(r, c) for r in range(2) for c in (3, 4)} and not {52, 53} & set(found)
    down = burning.inside_pixels(df.where("id = 50"), "id", F.col("rings"), 0.0, 10.0, 0.5).collect()
    assert {(r["row"], r["col"]) for r in down} == {(r, c) for r in range(13, 19) for c in range(1, 7)}
    lines = [(0, 0.5, 0.5, 1.5, 1.5), (1, 0.5, 1.5, 1.5, 0.5), (2, 1.0, 0.0, 1.0, 2.5), (3, 0.2, 3.0, 4.0, 3.0), (4, 2.2, 2.2, 2.3, 2.3), (5, 5.0, 5.0, 5.0, 5.0)]
    cells = {}
    for r in burning.touched_pixels(spark.createDataFrame(lines, "id long, ax double, ay double, bx double, by double"), "id").collect():
        cells.setdefault(r["id"], set()).add((r["row"], r["col"]))
    assert cells == {0: {(0, 0), (1, 1)}, 1: {(1, 0), (1, 1), (0, 1)}, 2: {(0, 1), (1, 1), (2, 1)}, 3: {(3, c) for c in range(5)}, 4: {(2, 2)}, 5: {(5, 5)}}
    random_lines = [(i, *(rng.uniform(-4, 9) for _ in range(4))) for i in range(25)]
    got = {(r["id"], r["row"], r["col"]) for r in burning.touched_pixels(spark.createDataFrame(random_lines, "id long, ax double, ay double, bx double, by double"), "id").collect()}
    want = set()
    for i, ax, ay, bx, by in random_lines:
        cuts = sorted({0.0, 1.0} | {(k - ax) / (bx - ax) for k in range(-5, 11)} | {(k - ay) / (by - ay) for k in range(-5, 11)})
        middles = [(a + b) / 2 for a, b in zip(cuts, cuts[1:]) if a >= 0 and b <= 1]
        want |= {(i, math.floor(ay + t * (by - ay)), math.floor(ax + t * (bx - ax))) for t in middles}
    assert got == want


def test_shapes_without_pixels_are_open_land(spark):
    df = spark.createDataFrame([(1, shape(square(0, 0, 4))), (2, shape(square(90, 90, 4))), (3, None)], f"id long, rings {RINGS}")
    pixels = spark.createDataFrame([(r, c, 1 if r < 3 else 5) for r in range(4) for c in range(4)], "row int, col int, class int")
    found = burning.zone_classes(df, "id", F.col("rings"), pixels, "class", 4).collect()
    assert {(r["id"], r["class"], r["share"]) for r in found} == {(1, 1, 0.75), (2, 4, 0.5), (3, 4, 0.5)}


def test_augmentation_moves_whole_chips(spark):
    size, n = 6, 40
    rows = [(k, i, j, ((i * size + j) * 7 + k) % 97 / 97.0, i * size + j) for k in range(n) for i in range(size) for j in range(size)]
    chips = spark.createDataFrame(rows, "chip int, row int, col int, red double, mask int").repartition(3)
    found = augmentation.augmented(chips, ["red"], size, 3).collect()
    assert len(found) == len(rows)
    again = {tuple(r) for r in augmentation.augmented(chips.repartition(7), ["red"], size, 3).collect()}
    assert {tuple(r) for r in found} == again
    kinds = set()
    for k in range(n):
        grid = np.full((size, size), -1)
        for r in found:
            if r["chip"] == k:
                grid[r["row"], r["col"]] = r["mask"]
        plain = np.arange(size * size).reshape(size, size)
        matches = [(f, q) for f in (0, 1) for q in range(4) if (np.rot90(np.fliplr(plain) if f else plain, q) == grid).all()]
        assert len(matches) == 1
        kinds.add(matches[0])
    assert len(kinds) > 5
    moved = augmentation.moved(chips, size, 3)
    assert {(r["chip"], r["mask"], r["red"]) for r in moved.collect()} == {(k, m, v) for k, _, _, v, m in rows}
    flat = chips.withColumn("red", F.lit(0.25))
    values = {(r["chip"], round(r["red"], 9)) for r in augmentation.augmented(flat, ["red"], size, 3).collect()}
    assert len(values) == n and 5 < sum(v == 0.25 for _, v in values) < n - 5


def test_a_grid_of_degrees_around_a_raster(spark):
    p = spark.createDataFrame([(r, c, 1.0 + r) for r in range(40) for c in range(30)], "row int, col int, v double")
    lon0, lat0, step, width, height = raster.grid_of_degrees(p, 43, 500000.0, 2000000.0, 10.0)
    assert lon0 == pytest.approx(75.0, abs=1e-9) and abs(width - 30) <= 2 and abs(height - 40) <= 2
    grid = spark.range(height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    found = {(r["row"], r["col"]): r["v"] for r in raster.reprojected(p, grid, lon0, lat0, step, 43, 500000.0, 2000000.0, 10.0).collect()}
    assert len(found) == width * height and found[20, 15] == pytest.approx(1 + 20 * 40 / height, abs=1.5)
    assert raster.grid_of_degrees(p.where("false"), 43, 0.0, 0.0, 1.0)[3:] == (0, 0)


def test_thick_blobs_are_thinned(spark):
    """A disc and a bar of more than a few rounds; nothing is left that is two pixels thick and wide."""
    cells = [(i, j) for i in range(60) for j in range(90) if (i - 20) ** 2 + (j - 20) ** 2 < 300 or 40 <= i < 55]
    left = {(r["row"], r["col"]) for r in raster.thin(spark.createDataFrame(cells, "row int, col int")).collect()}
    assert 0 < len(left) < 200


def test_masks_after_blending(spark):
    df = spark.createDataFrame([(0.5, 1.2, 2.6), (0.51, -0.1, 3.4)], "mask double, closeness double, class double")
    found = augmentation.rethresholded(df, ["mask"], "closeness", "class").collect()
    assert [tuple(r) for r in found] == [(0.0, 1.0, 3), (1.0, 0.0, 3)]


def test_manifests_of_splits(spark, tmp_path):
    import json

    from plotline.sources.reports import read_manifest

    (tmp_path / "a.json").write_text(json.dumps({"name": "x", "splits": {"train": [{"image_path": "i0", "mask_path": "m0"}, {"image_path": "i1", "mask_path": "m1"}], "val": []}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"splits": {"train": [{"image_path": "i2", "mask_path": None}]}}))
    assert sorted(r["image_path"] for r in read_manifest(spark, str(tmp_path), "train").collect()) == ["i0", "i1", "i2"]
    assert read_manifest(spark, str(tmp_path), "val").count() == 0 and read_manifest(spark, str(tmp_path), "test").count() == 0


def test_sets_of_rasters_that_do_not_fit(spark):
    from plotline.operators.rasters_qc import misaligned

    rows = [(1, "ORI", 9, 9, 0.0), (1, "DSM", 9, 9, 0.0), (1, "DTM", 9, 9, 0.0), (2, "DSM", 9, 9, 0.0), (2, "DTM", 8, 9, 0.0), (3, "ORI", 9, 9, 0.5), (3, "DSM", 9, 9, 0.0), (3, "DTM", 9, 9, 0.0), (4, "DTM", 9, 9, 0.0), (5, "ORI", 1, 1, 0.0)]
    df = spark.createDataFrame(rows, "site int, type string, w int, h int, x0 double").selectExpr("*", "0D AS y0", "0.1D AS gsd")
    assert {tuple(r) for r in misaligned(df, "site", "w", "h").collect()} == {(2, "models of unlike shape"), (3, "models not on the image's grid")}
