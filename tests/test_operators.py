"""Fixtures with known results, and brute force on small random inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.functions.geometry import polygon_area, ring_area
from plotline.operators import evaluation, network, raster, survey, tiling, validation, zonal
from plotline.operators.components import connected_components
from plotline.operators.spatial_join import meeting_pairs, nearest_box
from plotline.sources.geojson import read_features, write_features
from plotline.sources.points_csv import read_points

BOXES = "id long, x0 double, y0 double, x1 double, y1 double, conf double"


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], BOXES)


def pixels(spark, array, value="v"):
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(array) for j, x in enumerate(row)], f"row int, col int, {value} double")


def grid(df, value="v"):
    rows = df.collect()
    out = np.full((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def test_height_above_ground_removes_noise(spark):
    dsm = pixels(spark, [[100, 100.2, 110], [100, 100.3, 110], [99, 100, 100]])
    dtm = pixels(spark, np.full((3, 3), 100))
    assert grid(raster.height_above_ground(dsm, dtm)).tolist() == [[0, 0, 10], [0, 0, 0], [0, 0, 0]]


def test_slope_of_a_ramp_and_flat_excess_green(spark):
    ramp = pixels(spark, [[10, 15, 20]] * 3)
    assert np.allclose(grid(raster.slope_degrees(ramp), "slope"), 78.690068, atol=1e-5)
    flat = pixels(spark, np.zeros((4, 4))).select("row", "col", F.lit(50.0).alias("r"), F.lit(200.0).alias("g"), F.lit(50.0).alias("b"))
    assert (grid(raster.excess_green(flat), "exg") == 0).all()


def test_tile_offsets_and_stitch_identity(spark):
    assert tiling.offsets(240, 64, 0.25) == [0, 48, 96, 144, 176]
    assert tiling.offsets(240, 100, 0.20) == [0, 80, 140]
    assert tiling.offsets(30, 64, 0.25) == [0]
    a = np.random.default_rng(1).random((40, 50))
    p = pixels(spark, a)
    back = tiling.stitched(tiling.tiled_pixels(p, tiling.tiles(spark, 50, 40, 16, 0.25)))
    assert np.allclose(grid(back), a)


def test_distance_transform_components_and_thinning(spark):
    a = np.random.default_rng(2).random((12, 15)) > 0.3
    df = pixels(spark, a).select("row", "col", (F.col("v") == 1).alias("inside"))
    zeros = np.argwhere(~a)
    want = [[min(np.hypot(i - y, j - x) for y, x in zeros) for j in range(15)] for i in range(12)]
    assert np.allclose(grid(raster.distance_transform(df), "distance"), want)
    parts = connected_components(raster.neighbours(df.where("inside").select("row", "col")))
    sizes = sorted(r["count"] for r in parts.groupBy("component").count().collect())
    seen, brute = set(), []
    for start in map(tuple, np.argwhere(a)):
        todo, size = [start], 0
        while todo:
            c = todo.pop()
            if c in seen or not (0 <= c[0] < 12 and 0 <= c[1] < 15) or not a[c]:
                continue
            seen.add(c)
            size += 1
            todo += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
        brute.append(size)
    assert sizes == sorted(x for x in brute if x > 1)
    bar = pixels(spark, np.ones((5, 20))).select("row", "col")
    skeleton = raster.thin(bar)
    assert 0 < skeleton.count() < 25 and skeleton.select("row").distinct().count() <= 2


def test_components_of_chains_and_empty_edges(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (700, 700), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[501] == 500 and 700 not in found
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_rules_and_duplicates(spark):
    p = boxes(spark, [(0, 0, 10, 10, 0.9), (0, 0, 10, 10, 0.5), (8, 0, 18, 10, 0.4), (50, 0, 150, 1, 0.9)])
    kinds = sorted(r["type"] for r in validation.issues(p).collect())
    assert kinds == ["duplicate", "overlap", "overlap", "overlap", "shape_anomaly"]
    assert sorted(r["id"] for r in validation.heal_duplicates(p).collect()) == [0, 2, 3]
    clean = validation.summary(boxes(spark, [(0, 0, 10, 10, 1)]), validation.issues(boxes(spark, [(0, 0, 10, 10, 1)]))).first()
    assert clean["clean_percentage"] == 100.0 and clean["total_issues"] == 0
    assert validation.issues(boxes(spark, [])).count() == 0


def test_duplicate_fold_matches_the_sequential_one(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        x, y = rng.randrange(3) * 50 + rng.random() * 0.3, rng.randrange(3) * 50 + rng.random() * 0.3
        rows.append((x, y, x + 20, y + 20, rng.randrange(10) / 10))

    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return w * h / (800 - w * h)

    kept = set(range(60))
    for i in range(60):
        if i not in kept:
            continue
        for j in range(i + 1, 60):
            if j in kept and iou(rows[i], rows[j]) > 0.95:
                kept.discard(j if rows[i][4] >= rows[j][4] else i)
    assert {r["id"] for r in validation.heal_duplicates(boxes(spark, rows)).collect()} == kept


def test_grid_join_equals_nested_loop(spark):
    rng = random.Random(4)
    rows = [(x := rng.random() * 100, y := rng.random() * 100, x + rng.random() * 30, y + rng.random() * 30, 1) for _ in range(120)]
    b = boxes(spark, rows)
    found = {(r["a_id"], r["b_id"]) for r in meeting_pairs(b, b, 9.0, F.col("a_id") < F.col("b_id")).collect()}
    assert found == {(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if i < j and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]}


def test_nearest_box_is_exact_far_away_and_without_boxes(spark):
    b = boxes(spark, [(0, 0, 1, 1, 1), (5, 0, 6, 1, 1), (1000, 1000, 1001, 1001, 1)])
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 0.5), (3, -4000.0, 0.0), (4, 900.0, 900.0)], "seq long, x double, y double")
    assert {r["seq"]: r["id"] for r in nearest_box(p, b, "seq", "id", 2.0).collect()} == {1: 0, 2: 0, 3: 0, 4: 2}
    assert nearest_box(p, b.limit(0), "seq", "id", 2.0).count() == 0


def test_survey_fold_and_verdict(spark):
    m = spark.createDataFrame([(1, 7, 0.4), (2, 7, 0.8), (3, 7, 0.2)], "seq long, parcel long, offset double")
    r = survey.folded_offsets(m).first()
    assert r["gt_offset_m"] == pytest.approx(((0.4 + 0.8) / 2 + 0.2) / 2) and r["status"] == "verified"


def test_worklist_falls_back_to_all(spark):
    p = spark.createDataFrame([(1, 0.9, False, "auto"), (2, None, None, None)], "id long, conf double, needs_gt boolean, status string")
    assert validation.worklist(p).count() == 2
    assert validation.worklist(p.unionByName(spark.createDataFrame([(3, 0.1, False, "auto")], p.schema))).count() == 1


def test_boundary_f1_by_distance(spark):
    def f1(row):
        p = np.zeros((30, 20))
        t = np.zeros((30, 20))
        p[row], t[10] = 1, 1
        both = pixels(spark, p, "p").join(pixels(spark, t, "t"), ["row", "col"]).select("row", "col", (F.col("p") == 1).alias("p"), (F.col("t") == 1).alias("t"))
        return evaluation.boundary_f1(both, 3).first()[0]

    assert f1(10) == pytest.approx(1, abs=1e-4) and f1(11) == pytest.approx(1, abs=1e-4) and f1(20) == pytest.approx(0, abs=1e-4)


def test_accuracy_is_null_without_matches(spark):
    a, b = boxes(spark, [(0, 0, 1, 1, 1)]), boxes(spark, [(50, 50, 51, 51, 1)])
    r = evaluation.parcel_accuracy(a, b).first()
    assert r["mean_iou"] is None and r["completeness"] == 0


def test_noding_splits_at_crossings(spark):
    s = spark.createDataFrame([(1, 0.0, 5.0, 10.0, 5.0), (2, 5.0, 0.0, 5.0, 10.0), (3, 0.0, 20.0, 10.0, 20.0)], "line long, ax double, ay double, bx double, by double")
    assert {(r["line"], r["piece"]) for r in network.noded(s, 4.0).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)}


def test_landuse_names_and_histogram(spark):
    df = spark.createDataFrame([(" Water ",), ("built_up_other",), (None,), ("x",)], "n string")
    assert [r[0] for r in df.select(zonal.class_number(F.col("n"))).collect()] == [6, 8, 0, 0]
    assert {r["landuse"]: r["features"] for r in zonal.histogram(df, "n").collect()} == {" water ": 1, "built up_other": 1, "other": 1, "x": 1}


def test_polygon_area_with_hole(spark):
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    outer, hole = ring([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), ring([(1, 1), (2, 1), (2, 2), (1, 2)])
    r = spark.range(1).select(ring_area(outer).alias("a"), polygon_area(F.array(outer, hole)).alias("b")).first()
    assert (r["a"], r["b"]) == (16.0, 15.0)


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Point_ID,Easting,NORTHING,height\n1,10.5,20.5,3\n2,11,21,\n")
    assert [(r["x"], r["y"]) for r in read_points(spark, str(tmp_path / "p.csv")).orderBy("Point_ID").collect()] == [(10.5, 20.5), (11.0, 21.0)]
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="none of"):
        read_points(spark, str(tmp_path / "q.csv"))
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    layer = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"id": "b"}, "geometry": None}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": []}},
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(layer))
    found = read_features(spark, str(tmp_path / "l.geojson"))
    assert [len(r["rings"][0]) for r in found.collect()] == [4]
    write_features(found, str(tmp_path / "out"), "rings", ["pos"])
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert json.loads(line)["geometry"]["coordinates"] == square


def test_streamed_edits(spark, tmp_path):
    from plotline.streaming.edits import accepted_edits

    rows = [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 4, 5)]
    spark.createDataFrame(rows, "parcel long, seq long, version long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("parcel long, seq long, version long").parquet(str(tmp_path / "in"))
    q = accepted_edits(stream).writeStream.format("memory").queryName("edits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.seq, r.accepted, r.version) for r in spark.table("edits").collect()) == [(1, True, 2), (2, False, 2), (3, True, 3), (4, False, 1)]


def test_percentiles_by_refinement_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=900), 1: np.repeat([1.5, 2.5], [400, 3]), 2: np.array([7.0]), 3: 10.0 ** rng.uniform(-12, 12, 500)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(0, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    for buffered in (0, 1 << 20):
        cuts, few = raster.percentiles(df, "v", ["k"], [0.02, 0.5, 0.98, 1.0], buffered)
        got = {r["k"]: r["cuts"] for r in cuts.collect()}
        assert few and set(got) == set(groups) and all(np.allclose(got[k], np.percentile(v, [2, 50, 98, 100]), rtol=1e-12) for k, v in groups.items())
    flat = raster.stretch(df.withColumnRenamed("k", "key"), "v", ["key"], buffered=0)
    assert flat.count() == len(rows) and flat.where("key in (2, 4) or v is null").agg(F.max("stretched")).first()[0] == 0.0


def test_thinning_equals_brute_force(spark):
    rng = random.Random(9)
    pixels = {(r, c) for r in range(14) for c in range(18) if rng.random() < 0.75}
    df = spark.createDataFrame(sorted(pixels), "row int, col int")
    found = {(r["row"], r["col"]) for r in raster.thin(df).collect()}
    current, before = set(pixels), None
    while current != before:
        before = set(current)
        for step in (0, 1):
            gone = set()
            for r, c in current:
                p = [int((r + i, c + j) in current) for i, j in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                turns = sum(a == 0 and b == 1 for a, b in zip(p, p[1:] + p[:1]))
                first, second = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if step == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
                if 2 <= sum(p) <= 6 and turns == 1 and first == 0 and second == 0:
                    gone.add((r, c))
            current -= gone
    assert found == current


def test_faces_of_a_square_with_a_diagonal_and_dead_ends(spark):
    from plotline.operators.faces import polygonised

    lines = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0), (0, 0, 10, 10), (10, 10, 13, 14), (5, 5, 6, 4), (50, 50, 60, 50)]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(lines)], "line long, ax double, ay double, bx double, by double")
    found = polygonised(network.noded(df, 5.0)).collect()
    assert sorted((r["area"], r["edges"]) for r in found) == [(50.0, 4), (50.0, 4)] or sorted(r["area"] for r in found) == [50.0, 50.0]
    assert all(abs(r["perimeter"] - (20 + 200**0.5)) < 1e-9 and 4 * np.pi * r["area"] / r["perimeter"] ** 2 == pytest.approx(0.5390, abs=1e-4) for r in found)
    assert polygonised(network.noded(df.where("line >= 5"), 5.0)).count() == 0 and polygonised(network.noded(df.where("false"), 5.0)).count() == 0


def numbered(spark, rows):
    return spark.createDataFrame([(r[0], *map(float, r[1:]), 0.5) for r in rows], BOXES)


def test_slivers_join_the_neighbour_with_the_longest_border(spark):
    from plotline.operators.faces import merged_slivers

    two = numbered(spark, [(1, 0, 0, 10, 10), (2, 10, 0, 10.3, 10)])
    assert [(r["area"], r["members"]) for r in merged_slivers(two, 10.0, 0.2).collect()] == [(103.0, [1, 2])]
    rows = [(1, 0, 0, 10, 10), (2, 10, 0, 10.5, 10), (3, 10.5, 0, 30, 4), (4, 90, 90, 92, 93), (5, 80, 80, 81, 81)]
    got = {r["id"]: (r["area"], r["members"]) for r in merged_slivers(numbered(spark, rows)).collect()}
    assert got == {1: (105.0, [1, 2]), 3: (78.0, [3]), 4: (6.0, [4])}
    alone = numbered(spark, [(1, 0, 0, 1, 1), (2, 1, 0, 2, 1)])
    assert sorted(r["id"] for r in merged_slivers(alone).collect()) == [1, 2]


def test_overlaps_go_to_the_parcel_of_higher_confidence(spark):
    rows = [(1, 10.0, 0.0, 20.0, 10.0, 0.95), (2, 18.0, 0.0, 28.0, 10.0, 0.6), (3, 100.0, 0.0, 110.0, 10.0, 0.5), (4, 102.0, 2.0, 104.0, 4.0, 0.9), (5, 103.0, 3.0, 105.0, 5.0, 0.8), (6, 200.0, 0.0, 202.0, 2.0, 0.1), (7, 199.0, 0.0, 205.0, 5.0, 0.2)]
    p = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, conf double")
    got = {r["id"]: r for r in validation.clipped_overlaps(p).collect()}
    assert [tuple(x) for x in got[2]["pieces"]] == [(20.0, 0.0, 28.0, 10.0)] and got[2]["area"] == 80.0 and got[1]["clips"] == 0
    assert got[3]["area"] == 100 - 7 and got[5]["area"] == 3 and got[6]["area"] == 4  # wholly covered: stays
    again = [r for r in got.values() for q in got.values() if r["id"] < q["id"] < 6 for a in r["pieces"] for b in q["pieces"] if min(a["x1"], b["x1"]) > max(a["x0"], b["x0"]) and min(a["y1"], b["y1"]) > max(a["y0"], b["y0"])]
    assert not again


def test_ring_overlay_of_concave_rings():
    from plotline.functions.overlay import orthogonal, oriented_rectangle, shared, simplified

    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square, ell = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6))
    assert shared(square, ell) == pytest.approx(12.0) and shared(ell, square[::-1]) == pytest.approx(12.0)
    assert shared(ell, ell) == pytest.approx(20.0) and shared(square, ring((9, 9), (10, 9), (9, 10))) == 0.0
    rng = random.Random(1)
    for _ in range(20):  # stars of any shape against counting of a fine grid
        star = lambda: [(3 + (r := rng.uniform(0.5, 3)) * np.cos(a), 3 + r * np.sin(a)) for a in np.linspace(0, 6, 8)]
        a, b = star(), star()
        inside = lambda poly, x, y: sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in zip(poly, poly[1:] + poly[:1])) % 2
        cells = [(i / 20 + 0.025, j / 20 + 0.025) for i in range(120) for j in range(120)]
        assert shared(ring(*a), ring(*b)) == pytest.approx(sum(inside(a, *c) and inside(b, *c) for c in cells) / 400, abs=0.15)
    quad = ring((0, 0), (10, 0.5), (9.5, 10), (0, 9.8))
    made = orthogonal(quad)
    assert len(made) == 4 and oriented_rectangle(made)[0] > 9 and shared(made, quad) > 0.88 * 90
    assert orthogonal(ell) == ell and orthogonal(ring((0, 0), (0.1, 0), (0, 0.1))) == ring((0, 0), (0.1, 0), (0, 0.1))
    assert simplified(ring((0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)), 0.5) == ring((0, 0), (10, 0), (10, 10), (0, 10))
    assert simplified(ring((0, 0), (1, 0), (1, 1)), 5.0) == ring((0, 0), (1, 0), (1, 1)) and oriented_rectangle(ring((0, 0), (1, 1))) is None


def test_large_boxes_meet_small_ones_and_odd_coordinates_meet_nothing(spark):
    rng = random.Random(2)
    rows = [(i, x := rng.uniform(-500, 500), y := rng.uniform(-500, 500), x + rng.choice((0.0, 3.0, 40.0, 900.0)), y + rng.choice((0.0, 5.0, 700.0))) for i in range(150)]
    rows += [(900, -1e7, -1e7, 1e7, 1e7), (901, float("nan"), 0.0, 1.0, 1.0), (902, 0.0, 0.0, float("inf"), 1.0), (903, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["a_id"], r["b_id"]) for r in meeting_pairs(df, df, 10.0, F.col("a_id") < F.col("b_id")).collect())
    sound = [r for r in rows if r[0] <= 900]
    assert got == sorted((a[0], b[0]) for a in sound for b in sound if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, float("inf"), 0.0), (3, float("nan"), 1.0)], "seq long, x double, y double")
    assert [r["seq"] for r in nearest_box(points, df, "seq", "id", 25.0).collect()] == [1]


def test_duplicates_are_dropped_as_in_the_order_of_pairs(spark):
    """Clusters of near copies with any confidences, against the fold over pairs."""
    rng = random.Random(6)
    rows = [(i, 100.0 * (i % 5) + rng.uniform(0, 0.6), 0.0, 100.0 * (i % 5) + 20.0, 10.0, rng.choice((0.3, 0.5, 0.5, 0.9))) for i in range(60)]
    p = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, conf double")
    pairs = sorted((r["a_id"], r["b_id"]) for r in validation.duplicate_pairs(validation.candidate_pairs(p)).collect())
    conf, dropped = {r[0]: r[5] for r in rows}, set()
    for a in sorted({a for a, _ in pairs}):
        if a not in dropped:
            for b in (b for x, b in pairs if x == a and b not in dropped):
                dropped.add(b if conf[a] >= conf[b] else a)
    for folded in (20_000, 150, 0):
        assert len(pairs) > 100 and {r["id"] for r in validation.heal_duplicates(p, folded=folded).collect()} == set(conf) - dropped


def test_written_features_and_reports_are_read_again(spark, tmp_path):
    from plotline.sources.reports import write_report, write_table

    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    lines = [json.dumps({"type": "Feature", "properties": {"id": i}, "geometry": {"type": "Polygon", "coordinates": square}}) for i in range(3)]
    (tmp_path / "l.geojson").write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(lines) + "\n]}")
    found = read_features(spark, str(tmp_path / "l.geojson"))
    assert found.count() == 3
    write_features(found, str(tmp_path / "out"), "rings", ["pos"])
    again = read_features(spark, str(tmp_path / "out"))
    assert sorted(json.loads(r["properties"])["pos"] for r in again.collect()) == [0, 1, 2]
    assert {tuple((p["x"], p["y"]) for p in r["rings"][0]) for r in again.collect()} == {tuple(map(tuple, square[0]))}
    df = found.select("pos", "rings", F.lit(None).cast("string").alias("note"), F.lit(float("nan")).alias("score"))
    write_table(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["pos", "note", "score"]
    write_report(df.select("pos", "score"), str(tmp_path / "json"))
    texts = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted(t["pos"] for t in texts) == [0, 1, 2] and all(t["score"] is None for t in texts)


def test_split_counts_padding_and_fallback(spark):
    chips = lambda *parts: spark.createDataFrame([(p,) for p in parts], "split string")
    counted = lambda df: {r["split"]: r["chips"] for r in tiling.split_counts(df).collect()}
    assert counted(chips("train", "train", "test")) == {"train": 1, "val": 1, "test": 1} and counted(chips("train")) == {"train": 1, "val": 0, "test": 0}
    assert counted(chips("train", "val").where("false")) == {"train": 0, "val": 0, "test": 0}
    row = spark.range(1).select(raster.padded(F.array(F.lit(1.0)), 4).alias("a"), raster.padded(F.array(F.lit(1.0), F.lit(2.0)), 1).alias("b")).first()
    assert row["a"] == [1.0, 0.0, 0.0, 0.0] and row["b"] == [1.0, 2.0]
    some, existing = numbered(spark, [(1, 0, 0, 1, 1)]), numbered(spark, [(7, 0, 0, 1, 1), (8, 0, 0, 1, 1)])
    assert [(r["id"], r["source"], r["conf"]) for r in validation.or_existing(some, existing).collect()] == [(1, "ai", 0.5)]
    assert sorted((r["id"], r["source"], r["conf"], r["status"]) for r in validation.or_existing(some.where("false"), existing).collect()) == [(7, "existing", 0.85, "auto"), (8, "existing", 0.85, "auto")]
