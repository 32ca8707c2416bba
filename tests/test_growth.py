"""Steps whose cost must not outgrow their input."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plotline.functions.geometry import box_ring
from plotline.operators import arrangement, burning, network, ranking, raster, small_shapes, spatial_join, validation
from plotline.operators.checkpoints import checkpointed
from plotline.operators.spatial_join import meeting_pairs
from plotline.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_distances_of_a_tall_raster(spark):
    rng = np.random.default_rng(5)
    inside = rng.random((400, 5)) > 0.02
    df = spark.createDataFrame([(r, c, bool(inside[r, c])) for r in range(400) for c in range(5)], "row int, col int, inside boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = raster.distance_transform(df)
        got = {(r["row"], r["col"]): r["distance"] for r in made.collect()}
        none = raster.distance_transform(df.withColumn("inside", df["row"] >= 0)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows, cols = np.nonzero(~inside)
    want = {(r, c): float(np.sqrt(((rows - r) ** 2 + (cols - c) ** 2).min())) for r in range(400) for c in range(5)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(none) == 2000 and all(r["distance"] is None for r in none)
    # Such a frame is computed anew from every row of a column to its end.
    assert not re.search(r"currentrow\$\(\), unboundedfollowing\$\(\)", plan_of(made))


def test_joins_of_spelled_out_pixels_are_not_broadcast(spark, sf_dir):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 2.0)], "id long, x0 double, y0 double, x1 double, y1 double").withColumn("ring", box_ring())
    pixels = spark.createDataFrame([(0, 0, 7), (1, 2, 7), (1, 1, 8)], "row int, col int, class int")
    found = burning.zone_classes(boxes, "id", F.array("ring"), pixels, "class", 4)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 2 / 3)]
    for df, pairs in ((found, 1), (registry.QUERIES["zonal_pixels"](spark, sf_dir), 1)):
        assert plan_of(df).count("SortMergeJoin") >= pairs
    assert "BroadcastHashJoin" not in plan_of(registry.QUERIES["zonal_pixels"](spark, sf_dir))


def test_points_look_in_half_of_the_cells_around(spark):
    rng = np.random.default_rng(3)
    places = [(i, int(rng.integers(3)), float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(-6, 6, (120, 2)), 1))]
    made = network.bridges(spark.createDataFrame(places, "seq long, line long, x double, y double"), 2.5)
    want = {(a[0], b[0]) for a in places for b in places if a[0] < b[0] and a[1] != b[1] and 0.05 < np.hypot(a[2] - b[2], a[3] - b[3]) <= 2.5}
    got = [(r["a_seq"], r["b_seq"]) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "BroadcastHashJoin" not in plan_of(made)


def test_pairs_of_crowded_places_are_whole_and_small(spark, tmp_path):
    # More ends at a place than a row has, in one cell, around it and across the origin; some ends have no line or no place.
    rng = np.random.default_rng(9)
    spots = np.round(rng.uniform(-1.2, 1.2, (16, 2)), 2)
    ends = [(1000 * k + i, (7 * k + i) % 50, float(x), float(y)) for k in range(spatial_join.CROWD + 6) for i, (x, y) in enumerate(spots)]
    odd = [(None, 1, 0.0, 0.0), (7, None, 0.0, 0.0), (8, 1, None, 0.0), (9, 1, float("nan"), 0.0), (10, 1, float("inf"), 0.0), (0, 3, 0.5, 0.5)]
    made = network.bridges(spark.createDataFrame(ends + odd, "seq long, line long, x double, y double").repartition(3), 1.5, digits=3)
    made.select("a_seq", "b_seq", "distance").write.parquet(str(tmp_path / "pairs"))
    got = pq.read_table(str(tmp_path / "pairs")).to_pandas().sort_values(["a_seq", "b_seq", "distance"]).to_numpy()
    seq, line, x, y = np.array(sorted(ends + odd[-1:])).T
    far = np.hypot(x[:, None] - x, y[:, None] - y)
    a, b = np.nonzero((seq[:, None] < seq) & (line[:, None] != line) & (far > 0.05) & (far <= 1.5))
    want = np.column_stack([seq[a], seq[b], far[a, b]])
    want = want[np.lexsort(want.T[::-1])]
    assert got.shape == want.shape and np.array_equal(got[:, :2], want[:, :2]) and np.abs(got[:, 2] - want[:, 2]).max() < 0.00051
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1.2 * len(want)


def test_tasks_of_pairs_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "NEAR", 100)
    ends = spark.createDataFrame([(i, i, 0.1 * (i % 50), 0.0) for i in range(300)], "seq long, line long, x double, y double")
    crowded, few = network.bridges(ends), network.bridges(ends.limit(5))
    assert crowded.rdd.getNumPartitions() > 2 * few.rdd.getNumPartitions()
    assert few.count() == 4 + 3 + 2 + 1


def test_long_lines_share_their_vertices(spark):
    # A third of a long line has no few decimals.
    tall = 480060.0
    lines = [(i, i * 20.0, 0.0, i * 20.0, tall) for i in range(3)] + [(10 + j, 0.0, j * tall / 7, 40.0, j * tall / 7) for j in range(8)]
    pieces = network.noded(spark.createDataFrame(lines, "line long, ax double, ay double, bx double, by double"), 2000.0).collect()
    ends = [{(round(p[f"{e}x"], 6), round(p[f"{e}y"], 6)) for p in pieces if (p["line"] < 10) == long for e in "ab"} for long in (True, False)]
    assert len(pieces) == 3 * 7 + 8 * 2 and ends[0] == ends[1]


def test_boxes_of_finer_grids_do_not_meet_on_coarser_ones(spark):
    rows = [(i, i * 3.0, 0.0, i * 3.0 + 1, 1.0) for i in range(400)] + [(1000, 0.0, 0.5, 1200.0, 0.6)]
    boxes = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    made = meeting_pairs(boxes, boxes, 4.0, F.col("a_id") < F.col("b_id"))
    assert sorted((r["a_id"], r["b_id"]) for r in made.collect()) == [(i, 1000) for i in range(400)]
    assert "kind" in plan_of(made)


def test_rings_and_boxes_are_dealt_before_heavy_work(spark, sf_dir):
    for name in ("ring_shapes", "rasterize_boxes", "boundary_cells"):
        assert "REPARTITION_BY_NUM" in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString(), name


def test_small_shapes_are_arranged_without_a_shuffle(spark, monkeypatch):
    """Shapes of few segments give what joins give, in the task where their rows are."""
    rng = np.random.default_rng(11)
    ring = lambda n: [(float(x), float(y)) for x, y in rng.integers(0, 9, (n, 2))]
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(k, [ring(int(rng.integers(3, 7))) for _ in range(int(rng.integers(1, 3)))], [ring(5)]) for k in range(12)]
    rows += [(90, [square(0.0, 8.0), square(1.0, 3.0), square(5.0, 7.0)], [square(2.0, 6.0)]), (91, None, [square(0.0, 1.0)]), (92, [square(0.0, 9.0)], [square(3.0, 4.0)])]
    rings = "array<array<struct<x:double,y:double>>>"
    pairs = spark.createDataFrame(rows, f"id long, a {rings}, b {rings}")
    hows = list(arrangement.OVERLAYS.values())
    made = lambda: arrangement.outlines(arrangement.both_segments(pairs, "id", "a", "b"), hows, 2, arrangement.ring_sizes(pairs, "id", "a", "b"))
    shown = lambda df: sorted((r["shape"], r["which"], len(r["rings"]), r["area"], r["perimeter"]) for r in df.collect())
    few, alone = made(), shown(made())
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString() and {k for k, *_ in alone} >= {90, 91, 92}
    pieces = lambda: sorted(tuple(r) for r in arrangement.split_within(arrangement.both_segments(pairs, "id", "a", "b")).collect())
    cut = pieces()
    monkeypatch.setattr(arrangement, "FEW", 12)
    joined = shown(made())
    assert len(joined) == len(alone) and pieces() == cut
    assert all(a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-9) for a, b in zip(joined, alone, strict=True))


def test_shapes_of_few_segments_in_many_blocks(monkeypatch):
    """Blocks of few pairs and batches that end within a shape change nothing."""
    rng = np.random.default_rng(2)
    shape = np.sort(rng.integers(0, 30, 400))
    columns = [shape, np.zeros(400, np.int32), *rng.integers(0, 12, (4, 400)).astype(float)]
    whole = pa.record_batch([pa.array(c) for c in columns], names=["shape", "side", "ax", "ay", "bx", "by"])
    run = lambda step: sorted(str(r) for b in small_shapes.polygon_batches([arrangement.even_odd], 1)([whole.slice(i, step) for i in range(0, 400, step)]) for r in b.drop_columns(["part"]).to_pylist())
    want = run(400)
    monkeypatch.setattr(small_shapes, "PAIRS", 50)
    assert want and run(7) == want


def test_duplicates_are_folded_across_batches(spark):
    """Components are streamed, many in a task, wherever batches end."""
    rows = [(1, 1, 2, True), (1, 1, 3, False), (1, 1, 4, True), (1, 2, 5, True), (1, 3, 6, True), (7, 7, 8, False), (9, 9, 10, True), (9, 10, 11, True)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["component", "a_id", "b_id", "keep_a"])
    for step in (1, 2, 8):
        assert sorted(i for b in validation._folded([batch.slice(k, step) for k in range(0, 8, step)]) for i in b.column(0).to_pylist()) == [1, 2, 4, 6, 7, 10]
    pairs = spark.createDataFrame(rows, "component long, a_id long, b_id long, keep_a boolean").drop("component")
    made = validation.dropped_duplicates(pairs)
    assert "MapInArrow" in plan_of(made) and sorted(r["id"] for r in made.collect()) == [1, 2, 4, 6, 7, 10]


def test_points_look_at_the_boxes_of_one_cell(spark, monkeypatch):
    """A point is one row a grid, not one for every cell around it and every box near it."""
    monkeypatch.setattr(spatial_join, "CROWD", 3)
    rng = np.random.default_rng(8)
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(0, 40, (60, 4)))]
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-60, 120, (80, 2)))]
    counted: list[bool] = []
    monkeypatch.setattr(spatial_join, "checkpointed", lambda df: (counted.append("array_min" in plan_of(df)), checkpointed(df))[1])
    made = spatial_join.nearest_box(spark.createDataFrame(points, "seq long, x double, y double"), spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double"), "seq", "id", 5.0)
    far = lambda p, b: (float(np.hypot(max(b[1] - p[1], p[1] - b[3], 0), max(b[2] - p[2], p[2] - b[4], 0))), b[0])
    assert {r["seq"]: r["id"] for r in made.collect()} == {p[0]: min(far(p, b) for b in boxes)[1] for p in points}
    assert any(counted)


def test_thinning_takes_many_steps_a_round(spark, monkeypatch):
    calls = []
    for name in ("checkpointed", "written"):
        cut = getattr(raster, name)
        monkeypatch.setattr(raster, name, lambda *a, cut=cut: calls.append(1) or cut(*a))
    shape = np.ones((290, 200), bool)
    shape[100:104, 90:140] = shape[::37, ::41] = False
    places = spark.range(shape.size).select((F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200 - 70).cast("int").alias("col"), "id")
    lost = [int(i) for i in np.flatnonzero(~shape)]
    made = raster.thin(places.where(~F.col("id").isin(lost)).select("row", "col"))
    got = {(r["row"], r["col"] + 70) for r in made.collect()}
    grid, idle, step = np.pad(shape.astype(int), 1), 0, 0
    while idle < 2:
        p2, p3, p4, p5, p6, p7, p8, p9 = ring = [np.roll(grid, (-i, -j), (0, 1)) for i, j in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
        turns = sum((a == 0) & (b == 1) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        free = (p2 * p4 * p6 + p4 * p6 * p8 if step == 0 else p2 * p4 * p8 + p2 * p6 * p8) == 0
        goes = (grid == 1) & (sum(ring) >= 2) & (sum(ring) <= 6) & (turns == 1) & free
        grid, idle, step = grid - goes, 0 if goes.any() else idle + 1, 1 - step
    assert got == {(int(r), int(c)) for r, c in np.argwhere(grid[1:-1, 1:-1])} and made.dtypes == [("row", "int"), ("col", "int")]
    wide = spark.range(150 * 150).select((F.col("id") / 150).cast("int").alias("row"), (F.col("id") % 150).cast("int").alias("col"))
    assert 0 < raster.thin(wide).count() < 300 and len(calls) <= 8


def test_short_rings_leave_the_ranking_early(spark, monkeypatch):
    counts, cut = [], ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, *a: counts.append((made := cut(df, *a)).count()) or made)
    rng, links, want, number = np.random.default_rng(8), [], {}, 0
    for n, ring in [(150, True), (60, False), *[(1 + k % 9, True) for k in range(120)], (1, False)]:
        own = [int(i) for i in rng.permutation(n) + number]
        number += n
        links += [(a, own[i + 1] if i + 1 < n else own[0] if ring else None) for i, a in enumerate(own)]
        low = own.index(min(own))
        want |= {a: (min(own), (i - low) % n, True) if ring else (own[-1], i, False) for i, a in enumerate(own)}
    found = ranking.ranked(spark.createDataFrame(links, "link long, next long")).collect()
    assert len(found) == len(want) and {r["link"]: (r["chain"], r["seq"], r["ring"]) for r in found} == want
    assert max(counts[-3:]) <= 150 + 61 < counts[0]
