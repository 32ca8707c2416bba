"""Queries over polygons in any position, vectorised rasters, traced lines and chips, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions.geometry import box_ring, ring_bounds
from plotline.functions.projection import ALPHA, FALSE_EASTING, RADIUS, SCALE, N, central_meridian
from plotline.operators import arrangement, augmentation, burning, delineation, faces, healing, network, polygon_rules, raster, tracing, vectorise, watershed
from plotline.operators.checkpoints import written
from plotline.operators.spatial_join import meeting_pairs
from plotline.plans.parcel_queries import AREA, CUTS, ISSUES, PAIRS, network_lines, turned
from plotline.plans.raster_queries import r6
from plotline.plans.relations import PARCELS, PIXELS, parcels, pixels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return add


def aslant(spark, sf_dir):
    """Parcels turned by the angle of a triangle of sides 3, 4 and 5, so that vertices have few decimals."""
    turn = lambda p: F.struct((0.6 * p["x"] - 0.8 * p["y"]).alias("x"), (0.8 * p["x"] + 0.6 * p["y"]).alias("y"))
    rings = parcels(spark, sf_dir).select("id", "conf", F.transform(box_ring(), turn).alias("ring"))
    return rings.withColumn("rings", F.array("ring")).withColumn("b", ring_bounds(F.col("ring"))).select("id", "conf", "ring", "rings", "b.x0", "b.y0", "b.x1", "b.y1")


# Corners, holes and sides of a region follow from the 2 by 2 blocks around its pixels' corners.
@query("vectorised_regions", f"""WITH RECURSIVE {PIXELS}, m AS (SELECT row, col, row * 64 + col AS id FROM pixels WHERE v > 0.05::DOUBLE),
reach AS (SELECT id, row, col, id AS root FROM m UNION SELECT m.id, m.row, m.col, r.root FROM reach r JOIN (SELECT unnest([-1, 0, 0, 1]) AS i, unnest([0, -1, 1, 0]) AS j) o ON true JOIN m ON m.row = r.row + o.i AND m.col = r.col + o.j),
lab AS (SELECT id, any_value(row) AS row, any_value(col) AS col, min(root) AS label FROM reach GROUP BY id),
v AS (SELECT label, row + i AS r, col + j AS c, count(*) AS n, sum(2 * i + j) AS k FROM lab, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) o GROUP BY ALL),
q AS (SELECT label, count(*) FILTER (n = 1) AS q1, count(*) FILTER (n = 3) AS q3, count(*) FILTER (n = 2 AND k = 3) AS qd FROM v GROUP BY label),
e AS (SELECT a.label, count(*) AS joined FROM lab a JOIN lab b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col) GROUP BY a.label),
n AS (SELECT label, count(*) AS area FROM lab GROUP BY label)
SELECT (label // 64)::BIGINT * 4294967296 + label % 64 AS region, area::DOUBLE AS area, (4 * area - 2 * coalesce(joined, 0))::DOUBLE AS perimeter, q1 + q3 + 2 * qd AS corners, 1 - (q1 - q3 - 2 * qd) // 4 AS holes
FROM n JOIN q USING (label) LEFT JOIN e USING (label)""")
def vectorised_regions(spark, sf_dir):
    """Polygons of all regions of a mask: area, perimeter, corners of all rings and holes."""
    mask = pixels(spark, sf_dir).where("v > 0.05").select("row", "col", F.lit(1).alias("label"))
    found = vectorise.polygons(vectorise.ring_corners(vectorise.regions(mask)))
    corners = F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r))
    return found.select("region", "area", "perimeter", corners.cast("long").alias("corners"), "holes")


@query("repaired_rings", f"""WITH {PARCELS} SELECT id, 2::BIGINT AS parts, round({AREA} / 2, 4) AS area, round(2 * (y1 - y0) + 2 * sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 4) AS perimeter FROM parcels""")
def repaired_rings(spark, sf_dir):
    """Parcels with two corners exchanged: each becomes the two triangles of its figure of eight."""
    p = aslant(spark, sf_dir)
    bow = F.array(*[F.get("ring", F.lit(i)) for i in (0, 3, 1, 2)])
    found = healing.repaired(p.select("id", "conf", F.array(bow).alias("rings")))
    return found.groupBy("id").agg(F.count("*").alias("parts"), F.round(F.sum("area"), 4).alias("area"), F.round(F.sum("perimeter"), 4).alias("perimeter"))


@query("overlay_areas", f"""WITH {PARCELS}, {PAIRS} SELECT a_id, b_id, round(area_a + area_b - shared, 4) AS union_area, round(shared, 4) AS shared_area, round(area_a - shared, 4) AS rest_area, round(area_a + area_b - 2 * shared, 4) AS other_area
FROM pairs WHERE shared > 0""")
def overlay_areas(spark, sf_dir):
    """Union, intersection, difference and symmetric difference of all pairs of parcels that overlap, as polygons."""
    p = aslant(spark, sf_dir)
    pairs = meeting_pairs(p, p, 40.0, F.col("a_id") < F.col("b_id"))
    named = written(pairs.select("a_id", "b_id", F.monotonically_increasing_id().alias("pair"), "a_rings", "b_rings"))
    hows = {"union": "union_area", "intersection": "shared_area", "difference": "rest_area", "symmetric": "other_area"}
    segments, sizes = arrangement.both_segments(named, "pair", "a_rings", "b_rings"), arrangement.ring_sizes(named, "pair", "a_rings", "b_rings")
    made = arrangement.outlines(segments, [arrangement.OVERLAYS[how] for how in hows], 2, sizes)
    area = lambda k, name: F.coalesce(F.sum(F.when(F.col("which") == k, F.col("area"))), F.lit(0.0)).alias(name)
    areas = made.groupBy(F.col("shape").alias("pair")).agg(*[area(k, name) for k, name in enumerate(hows.values())], F.bool_or(F.col("which") == 1).alias("meet")).where("meet")
    return named.select("pair", "a_id", "b_id").join(areas, "pair").select("a_id", "b_id", *[F.round(c, 4).alias(c) for c in hows.values()])


@query("dissolved_parcels", f"""WITH {PARCELS}, b AS (SELECT id // 10 AS block, x0, y0, x1, y1 FROM parcels),
xs AS (SELECT block, x AS lx, lead(x) OVER (PARTITION BY block ORDER BY x) AS hx FROM (SELECT block, x0 AS x FROM b UNION SELECT block, x1 FROM b)),
ys AS (SELECT block, y AS ly, lead(y) OVER (PARTITION BY block ORDER BY y) AS hy FROM (SELECT block, y0 AS y FROM b UNION SELECT block, y1 FROM b))
SELECT block, round(sum((hx - lx) * (hy - ly)), 4) AS area FROM xs JOIN ys USING (block) WHERE EXISTS (SELECT 1 FROM b WHERE b.block = xs.block AND b.x0 <= lx AND b.x1 >= hx AND b.y0 <= ly AND b.y1 >= hy) GROUP BY block""")
def dissolved_parcels(spark, sf_dir):
    """Blocks of parcels dissolved to polygons, overlaps counted once."""
    p = aslant(spark, sf_dir).select((F.floor(F.col("id") / 10)).cast("long").alias("block"), "rings")
    return arrangement.dissolved(p, "block", "rings").groupBy(F.col("shape").alias("block")).agg(F.round(F.sum("area"), 4).alias("area"))


# A join of two strips: the square that both cover, and a fan of eight chords on the other side.
@query("line_buffers", f"WITH {PARCELS} SELECT id, 1::BIGINT AS parts, round(0.4::DOUBLE * ((x1 - x0) + (y1 - y0)) - 0.04::DOUBLE + 0.02::DOUBLE * 8 * sin(pi() / 16), 3) AS area FROM parcels")
def line_buffers(spark, sf_dir):
    """Two sides of every parcel as a line, widened to a strip with flat ends and a round bend."""
    ends = F.array(*[F.get("ring", F.lit(i)) for i in range(3)])
    lines = aslant(spark, sf_dir).select("id", ends.alias("points"))
    found = arrangement.lines_buffered(lines, "id", "points", F.lit(0.2))
    return found.groupBy(F.col("shape").alias("id")).agg(F.count("*").alias("parts"), F.round(F.sum("area"), 3).alias("area"))


@query("face_rings", """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 9), top AS (SELECT max(k // 50) + 1 AS n FROM p),
c AS (SELECT i.i * 20 AS x0, j.j * 20 AS y0, i.i + 50 * j.j AS k FROM (SELECT unnest(generate_series(0, 49)) AS i) i, (SELECT unnest(generate_series(0, (SELECT n - 1 FROM top))) AS j) j),
d AS (SELECT c.*, p.k IS NOT NULL AND c.k % 13 = 0 AS island FROM c LEFT JOIN p USING (k))
SELECT x0::DOUBLE AS x0, y0::DOUBLE AS y0, CASE WHEN island THEN 391 ELSE 400 END::DOUBLE AS area, CASE WHEN island THEN 92 ELSE 80 END::DOUBLE AS perimeter, CASE WHEN island THEN 2 ELSE 1 END::BIGINT AS rings FROM d
UNION ALL SELECT x0 + 2, y0 + 2, 9, 12, 1 FROM d WHERE island""")
def face_rings(spark, sf_dir):
    """Faces as polygons: lines in pieces that overlap, dead ends, and islands that are cut out of the face around them."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k")).where("k % 10 <> 9")
    cells = p.select("k", ((F.col("k") % 50) * 20).cast("double").alias("x"), (F.floor(F.col("k") / 50) * 20).cast("double").alias("y"))
    top = cells.agg((F.max("y") + 20.0).alias("top"))
    line = lambda df, ax, ay, bx, by: df.select(ax.cast("double").alias("ax"), ay.cast("double").alias("ay"), bx.cast("double").alias("bx"), by.cast("double").alias("by"))
    x, y, zero = F.col("x"), F.col("y"), F.lit(0.0)
    rows = top.select(F.explode(F.sequence(F.lit(0), (F.col("top") / 20).cast("int"))).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(49))))
    found = line(rows, F.col("i") * 20, F.col("j") * 20, F.least(F.col("i") * 20 + 30, F.lit(1000)), F.col("j") * 20)
    found = found.unionByName(line(top.select("top", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("i")), F.col("i") * 20, zero, F.col("i") * 20, F.col("top")))
    found = found.unionByName(line(cells.where("k % 11 = 0 and k % 13 <> 0"), x, y, x + 6, y + 3))
    island = cells.where("k % 13 = 0")
    for ax, ay, bx, by in ((2, 2, 5, 2), (5, 2, 5, 5), (5, 5, 2, 5), (2, 5, 2, 2)):
        found = found.unionByName(line(island, x + ax, y + ay, x + bx, y + by))
    pieces = network.noded(found.withColumn("line", F.xxhash64("ax", "ay", "bx", "by")), 20.0)
    made = faces.face_polygons(pieces, 20.0, 5.0).withColumn("b", ring_bounds(F.get("rings", F.lit(0))))
    return made.select("b.x0", "b.y0", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"), F.size("rings").cast("long").alias("rings"))


@query("healed_rings", f"""WITH {PARCELS}, {PAIRS}, {CUTS} SELECT id, coalesce(clips, 0) AS clips, round(coalesce(area, {AREA}), 4) AS area FROM parcels LEFT JOIN left_ USING (id) LEFT JOIN n USING (id)""")
def healed_rings(spark, sf_dir):
    """Overlaps of turned parcels cut out of the one of lower confidence; polygons stay polygons."""
    found = healing.healed_overlaps(aslant(spark, sf_dir), 40.0)
    return found.groupBy("id").agg(F.max("clips").alias("clips"), F.round(F.sum("area"), 4).alias("area"))


def faulty(spark, sf_dir):
    """Turned parcels, of which some have no shell, some two corners exchanged, some a hole beside the shell, both far from the rest."""
    p, k = aslant(spark, sf_dir).select("id", "conf", "ring"), F.col("id") % 130
    moved = lambda ring, dx, dy: F.transform(ring, lambda v: F.struct((v["x"] + dx).alias("x"), (v["y"] + dy).alias("y")))
    bow = F.array(*[F.get(moved("ring", 0, -5000), F.lit(i)) for i in (0, 3, 1, 2)])
    beside = F.array(moved("ring", 0, -9000), moved("ring", 100, -9000))
    return p.select("id", "conf", F.when(k == 5, F.array(bow)).when(k == 20, None).when(k == 35, beside).otherwise(F.array("ring")).alias("rings"))


FAULTY = PARCELS.replace("parcels AS", "every AS", 1) + ", whole AS (SELECT * FROM every WHERE id % 130 NOT IN (5, 20, 35))"
# Duplicates of this relation are disjoint pairs, for which the fold is a comparison.
KEPT = f"""{PAIRS.replace("parcels", "whole").replace("pairs AS", "all_pairs AS", 1)},
gone AS (SELECT CASE WHEN a_conf >= b_conf THEN b_id ELSE a_id END AS id FROM all_pairs WHERE iou > 0.95::DOUBLE),
parcels AS (SELECT * FROM whole WHERE id NOT IN (SELECT id FROM gone)), {PAIRS}, {CUTS}"""


@query("polygon_issues", f"""WITH {FAULTY}, parcels AS (SELECT * FROM whole), {PAIRS}, {ISSUES}, f AS (
SELECT * FROM issues UNION ALL
SELECT 1, id, NULL, 'invalid', 'error', id::VARCHAR, CASE id % 130 WHEN 5 THEN 'ring meets itself' WHEN 20 THEN 'no geometry' ELSE 'rings overlap' END,
  CASE id % 130 WHEN 20 THEN 'delete' ELSE 'make_valid' END FROM every WHERE id % 130 IN (5, 20, 35))
SELECT *, printf('issue_%d_%05d_%05d', rule, first_id, coalesce(second_id, 0)) AS issue_key FROM f""")
def polygon_issues(spark, sf_dir):
    """All rules on polygons in any position, some of which are not valid."""
    return polygon_rules.polygon_issues(faulty(spark, sf_dir), 40.0)


@query("auto_fixed_polygons", f"""WITH {FAULTY}, {KEPT}
SELECT id, coalesce(clips, 0) AS clips, round(coalesce(area, {AREA}), 4) AS area FROM parcels LEFT JOIN left_ USING (id) LEFT JOIN n USING (id)
UNION ALL SELECT id, 0, round(CASE id % 130 WHEN 5 THEN 0.5::DOUBLE WHEN 20 THEN 0::DOUBLE ELSE 2::DOUBLE END * {AREA}, 4) FROM every WHERE id % 130 IN (5, 20, 35)""")
def auto_fixed_polygons(spark, sf_dir):
    """Polygons after repair, removal of duplicates and clipping."""
    found, _ = polygon_rules.auto_fixed(faulty(spark, sf_dir), 40.0)
    return found.groupBy("id").agg(F.max("clips").alias("clips"), F.round(F.sum("area"), 4).alias("area"))


@query("auto_fix_audit", f"""WITH {FAULTY}, {KEPT}
SELECT id, 'make_valid' AS action, NULL::BIGINT AS against FROM every WHERE id % 130 IN (5, 35) UNION ALL SELECT id, 'drop_duplicate', NULL FROM gone
UNION ALL SELECT id, 'clip_overlap', other FROM over WHERE id IN (SELECT id FROM left_)""")
def auto_fix_audit(spark, sf_dir):
    """What the automatic fixes did to which polygon."""
    return polygon_rules.auto_fixed(faulty(spark, sf_dir), 40.0)[1]


@query("merged_sliver_rings", f"""WITH {PARCELS}, m AS (
  SELECT *, {AREA} AS area, {AREA} < 15 OR 4 * pi() * {AREA} / pow(2 * ((x1 - x0) + (y1 - y0)), 2) < 0.05::DOUBLE AS sliver FROM parcels), p AS (
  SELECT a.id, b.id AS n, a.area, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS w, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS h
  FROM m a JOIN m b ON a.sliver AND NOT b.sliver AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1), q AS (
  SELECT id, n, CASE WHEN w > 0 AND h > 0 THEN 2 * (w + h) ELSE w + h END AS border FROM p), r AS (
  SELECT * FROM q WHERE border > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY border DESC, n) = 1),
g AS (SELECT n AS face, id FROM r UNION ALL SELECT id, id FROM m WHERE NOT sliver UNION ALL SELECT id, id FROM m WHERE sliver AND area >= 5 AND id NOT IN (SELECT id FROM r)),
b AS (SELECT g.face, x0, y0, x1, y1 FROM g JOIN parcels USING (id)),
xs AS (SELECT face, x AS lx, lead(x) OVER (PARTITION BY face ORDER BY x) AS hx FROM (SELECT face, x0 AS x FROM b UNION SELECT face, x1 FROM b)),
ys AS (SELECT face, y AS ly, lead(y) OVER (PARTITION BY face ORDER BY y) AS hy FROM (SELECT face, y0 AS y FROM b UNION SELECT face, y1 FROM b))
SELECT face AS id, round(sum((hx - lx) * (hy - ly)), 4) AS area FROM xs JOIN ys USING (face) WHERE EXISTS (SELECT 1 FROM b WHERE b.face = xs.face AND b.x0 <= lx AND b.x1 >= hx AND b.y0 <= ly AND b.y1 >= hy) GROUP BY face""")
def merged_sliver_rings(spark, sf_dir):
    """Faces with the slivers that join them, as the polygons of their union."""
    found = faces.merged_sliver_polygons(parcels(spark, sf_dir))
    return found.groupBy("id").agg(F.round(F.sum("area"), 4).alias("area"))


def blobs(spark, sf_dir):
    """Set pixels of a mask that hangs together in places, with their distance to its edge and a height."""
    mask = raster.dilate(pixels(spark, sf_dir).select("row", "col", (F.col("v") > 0.15).cast("int").alias("v")))
    held = raster.distance_transform(mask.select("row", "col", (F.col("v") == 1).alias("inside"))).where("inside")
    return held.join(pixels(spark, sf_dir).hint("merge"), ["row", "col"]).select("row", "col", "distance", (20 * F.col("v")).alias("height"))


# SQL can't express the forest of lowest passes; the tests compare it with Kruskal's on small masks.
@query("watershed_instances")
def watershed_instances(spark, sf_dir):
    """Instances of a mask, split at the narrow places between peaks of distance weighted by height, and their sizes."""
    known = blobs(spark, sf_dir).select("row", "col", raster.weighted_distance(F.col("distance"), F.col("height")).alias("distance"))
    return watershed.instances(known).groupBy("label").agg(F.count("*").alias("pixels"))


# SQL can't thin; the tests compare the lines of small skeletons with those found by walking.
@query("traced_lines")
def traced_lines(spark, sf_dir):
    """Centre lines of a mask with their lengths and widths."""
    known = blobs(spark, sf_dir)
    skeleton = raster.thin(known.select("row", "col")).join(known.select("row", "col", "distance"), ["row", "col"])
    return tracing.center_lines(skeleton, "distance", 3.0).select("line", F.size("points").alias("points"), r6("length"), r6("width"))


C, S = 0.7648421872844885, 0.644217687237691  # cosine and sine of 0.7
INSIDE = f"{C}::DOUBLE * (col + 0.5::DOUBLE) + {S}::DOUBLE * (row + 0.5::DOUBLE) BETWEEN x0 AND x1 AND {C}::DOUBLE * (row + 0.5::DOUBLE) - {S}::DOUBLE * (col + 0.5::DOUBLE) BETWEEN y0 AND y1"


@query("ring_pixels", f"""WITH {PARCELS}, b AS (SELECT *, {C}::DOUBLE * x0 - {S}::DOUBLE * y1 AS lx, {C}::DOUBLE * x1 - {S}::DOUBLE * y0 AS hx, {S}::DOUBLE * x0 + {C}::DOUBLE * y0 AS ly, {S}::DOUBLE * x1 + {C}::DOUBLE * y1 AS hy FROM parcels),
r AS (SELECT *, unnest(generate_series(floor(ly)::BIGINT - 1, ceil(hy)::BIGINT + 1)) AS row FROM b), c AS (SELECT *, unnest(generate_series(floor(lx)::BIGINT - 1, ceil(hx)::BIGINT + 1)) AS col FROM r)
SELECT id, count(*) AS pixels, sum(row)::BIGINT AS rows_, sum(col)::BIGINT AS cols_ FROM c WHERE {INSIDE} GROUP BY id""")
def ring_pixels(spark, sf_dir):
    """Pixels whose centre lies in a turned parcel."""
    found = burning.inside_pixels(turned(spark, sf_dir, F.lit(0.7)), "id", F.array("ring"))
    return found.groupBy("id").agg(F.count("*").alias("pixels"), F.sum("row").alias("rows_"), F.sum("col").alias("cols_"))


@query("ring_landuse", f"""WITH {PARCELS}, {PIXELS}, z AS (SELECT id, floor(20 * abs(v))::BIGINT AS class, count(*) AS n FROM parcels JOIN pixels ON {INSIDE} GROUP BY ALL),
m AS (SELECT id, class, n / sum(n) OVER (PARTITION BY id) AS share, row_number() OVER (PARTITION BY id ORDER BY n DESC, class) AS r FROM z)
SELECT id, coalesce(class, 4) AS class, round(coalesce(share, 0.5::DOUBLE), 6) AS share FROM parcels LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (id)""")
def ring_landuse(spark, sf_dir):
    """Most frequent class of the pixels in every turned parcel; open land, by half, where there are none."""
    p = pixels(spark, sf_dir).select("row", "col", F.floor(20 * F.abs("v")).cast("long").alias("class"))
    found = burning.zone_classes(turned(spark, sf_dir, F.lit(0.7)), "id", F.array("ring"), p, "class", 4)
    return found.select("id", F.col("class").cast("long").alias("class"), F.round("share", 6).alias("share"))


@query("boundary_cells", f"""WITH {PARCELS}, k AS (SELECT id, {C}::DOUBLE * x - {S}::DOUBLE * y AS x, {S}::DOUBLE * x + {C}::DOUBLE * y AS y, c FROM (
  SELECT id, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y, unnest([0, 1, 2, 3]) AS c FROM parcels)),
e AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM k a JOIN k b ON a.id = b.id AND b.c = (a.c + 1) % 4),
r AS (SELECT *, unnest(generate_series(floor(least(ay, "by"))::BIGINT, floor(greatest(ay, "by"))::BIGINT)) AS row FROM e), g AS (SELECT *, unnest(generate_series(floor(least(ax, bx))::BIGINT, floor(greatest(ax, bx))::BIGINT)) AS col FROM r),
t AS (SELECT id, row, col, greatest(0, least((col - ax) / (bx - ax), (col + 1 - ax) / (bx - ax)), least((row - ay) / ("by" - ay), (row + 1 - ay) / ("by" - ay))) AS t0,
  least(1, greatest((col - ax) / (bx - ax), (col + 1 - ax) / (bx - ax)), greatest((row - ay) / ("by" - ay), (row + 1 - ay) / ("by" - ay))) AS t1 FROM g)
SELECT id, count(*) AS cells, sum(row)::BIGINT AS rows_, sum(col)::BIGINT AS cols_ FROM (SELECT DISTINCT id, row, col FROM t WHERE t0 <= t1) GROUP BY id""")
def boundary_cells(spark, sf_dir):
    """All pixels that the outline of a turned parcel passes through."""
    edges = burning.ring_edges(turned(spark, sf_dir, F.lit(0.7)), "id", F.array("ring"))
    found = burning.touched_pixels(edges, "id")
    return found.groupBy("id").agg(F.count("*").alias("cells"), F.sum("row").alias("rows_"), F.sum("col").alias("cols_"))


LON0, LAT0, STEP = 75.0001, 18.0879, 0.00009


def _reprojected_sql() -> str:
    e = 2 * N**0.5 / (1 + N)
    xi, eta = "xi_", "eta_"
    for j, a in enumerate(ALPHA, 1):
        xi += f" + ({a!r})::DOUBLE * sin({2 * j} * xi_) * cosh({2 * j} * eta_)"
        eta += f" + ({a!r})::DOUBLE * cos({2 * j} * xi_) * sinh({2 * j} * eta_)"
    return f"""WITH {PIXELS}, g AS (SELECT row, col, radians({LON0}::DOUBLE + (col + 0.5::DOUBLE) * {STEP}::DOUBLE - {central_meridian(43)}::DOUBLE) AS lam, radians({LAT0}::DOUBLE - (row + 0.5::DOUBLE) * {STEP}::DOUBLE) AS phi FROM pixels),
s AS (SELECT row, col, lam, sinh(atanh(sin(phi)) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(phi))) AS t FROM g), u AS (SELECT row, col, atan2(t, cos(lam)) AS xi_, atanh(sin(lam) / sqrt(1 + t * t)) AS eta_ FROM s),
w AS (SELECT row, col, (2000000 - {SCALE * RADIUS!r}::DOUBLE * ({xi})) / 10 - 0.5::DOUBLE AS y, ({FALSE_EASTING}::DOUBLE + {SCALE * RADIUS!r}::DOUBLE * ({eta}) - 500000) / 10 - 0.5::DOUBLE AS x FROM u),
t AS (SELECT w.row, w.col, (1 - abs(y - p.row)) * (1 - abs(x - p.col)) AS k, p.v FROM w JOIN (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) o ON true JOIN pixels p ON p.row = floor(y) + i AND p.col = floor(x) + j),
q AS (SELECT row, col, sum(k) AS ws, sum(k * v) AS vs FROM t GROUP BY row, col) SELECT w.row, w.col, round(coalesce(vs / nullif(ws, 0), 0), 5) + 0 AS v FROM w LEFT JOIN q USING (row, col)"""


@query("reprojected", _reprojected_sql())
def reprojected(spark, sf_dir):
    """The raster, 10 m a pixel in UTM zone 43, on a grid of degrees that reaches beyond it."""
    p = pixels(spark, sf_dir)
    found = raster.reprojected(p, p.select("row", "col"), LON0, LAT0, STEP, 43, 500000.0, 2000000.0, 10.0)
    return found.select("row", "col", (F.round("v", 5) + 0.0).alias("v"))


SIZE, SEED = 16, 7


def _draw(name: str) -> str:
    return f"('0x' || substr(md5('{SEED}:{name}:' || chip), 1, 8))::BIGINT / 4294967296::DOUBLE"


def _augmented_sql() -> str:
    taps = ", ".join(f"({n}, {k}, {w!r}::DOUBLE)" for n in (1, 2) for k, w in zip(range(-n, n + 1), augmentation._weights(n)))
    mirror = lambda c: f"CASE WHEN {c} + k < 0 THEN -({c} + k) WHEN {c} + k >= {SIZE} THEN {2 * SIZE - 2} - {c} - k ELSE {c} + k END"
    return f"""WITH {PIXELS}, n AS (SELECT (max(row) + 1) // {SIZE} AS n FROM pixels),
c AS (SELECT (row // {SIZE}) * 4 + col // {SIZE} AS chip, row % {SIZE} AS row, col % {SIZE} AS col, least(greatest(0.5::DOUBLE + 2 * v, 0), 1) AS red, (v > 0.05::DOUBLE)::INTEGER AS mask FROM pixels, n WHERE row // {SIZE} < n),
d AS (SELECT chip, {_draw("jitter")} AS j, (2 * ({_draw("contrast")}) - 1) * 0.15::DOUBLE AS a, (2 * ({_draw("brightness")}) - 1) * 0.15::DOUBLE AS b, {_draw("blur")} AS p, {_draw("width")} AS w,
  {_draw("upside")} AS u, {_draw("sideways")} AS s, {_draw("turn")} AS t, floor(4 * ({_draw("quarters")})) AS k FROM (SELECT DISTINCT chip FROM c)),
h AS (SELECT *, CASE WHEN p >= 0.3::DOUBLE THEN 0 WHEN w < 0.5::DOUBLE THEN 1 ELSE 2 END AS n FROM d),
x AS (SELECT c.chip, row, col, n, mask, CASE WHEN j < 0.5::DOUBLE THEN least(greatest(red * (1 + a) + b, 0), 1) ELSE red END AS red FROM c JOIN h USING (chip)),
taps AS (SELECT * FROM (VALUES (0, 0, 1::DOUBLE), {taps}) v(n, k, w)),
y AS (SELECT x.chip, x.row, x.col, x.n, x.mask, sum(w * q.red) AS red FROM x JOIN taps USING (n) JOIN x q ON q.chip = x.chip AND q.row = x.row AND q.col = {mirror("x.col")} GROUP BY ALL),
z AS (SELECT y.chip, y.row, y.col, y.mask, sum(w * q.red) AS red FROM y JOIN taps USING (n) JOIN y q ON q.chip = y.chip AND q.col = y.col AND q.row = {mirror("y.row")} GROUP BY ALL),
f AS (SELECT z.chip, mask, red, CASE WHEN u < 0.5::DOUBLE THEN {SIZE - 1} - row ELSE row END AS r, CASE WHEN s < 0.5::DOUBLE THEN {SIZE - 1} - col ELSE col END AS c, CASE WHEN t < 0.5::DOUBLE THEN k ELSE 0 END AS q FROM z JOIN h USING (chip))
SELECT chip::INTEGER AS chip, (CASE q WHEN 0 THEN r WHEN 1 THEN {SIZE - 1} - c WHEN 2 THEN {SIZE - 1} - r ELSE c END)::INTEGER AS row, (CASE q WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN {SIZE - 1} - c ELSE {SIZE - 1} - r END)::INTEGER AS col, round(red, 6) AS red, mask FROM f"""


@query("augmented_chips", _augmented_sql())
def augmented_chips(spark, sf_dir):
    """Whole chips of the raster with jitter, blur, flips and turns drawn from a hash of the chip."""
    p = pixels(spark, sf_dir)
    whole = p.agg(F.max("row")).select(F.floor((F.col("max(row)") + 1) / SIZE).alias("whole"))
    chip = (F.floor(F.col("row") / SIZE) * 4 + F.floor(F.col("col") / SIZE)).cast("int")
    red = F.least(F.greatest(0.5 + 2 * F.col("v"), F.lit(0.0)), F.lit(1.0))
    kept = p.join(F.broadcast(whole), F.floor(F.col("row") / SIZE) < F.col("whole"))
    chips = kept.select(chip.alias("chip"), (F.col("row") % SIZE).alias("row"), (F.col("col") % SIZE).alias("col"), red.alias("red"), (F.col("v") > 0.05).cast("int").alias("mask"))
    return augmentation.augmented(chips, ["red"], SIZE, SEED).select("chip", "row", "col", F.round("red", 6).alias("red"), "mask")


# SQL can't express the watershed; footprints are tested on fixtures.
@query("building_footprints")
def building_footprints(spark, sf_dir):
    """Footprints of the blobs of a mask: instances, polygons, squared shells, confidence and height."""
    mask = raster.dilate(pixels(spark, sf_dir).select("row", "col", F.when(F.col("v") > 0.15, 0.5 + F.col("v")).otherwise(0.0).alias("v")))
    p = mask.withColumnRenamed("v", "p").join(pixels(spark, sf_dir).hint("merge"), ["row", "col"]).select("row", "col", "p", (20 * F.col("v")).alias("height"))
    found = delineation.footprints(p)
    return found.select("region", F.size("rings").alias("rings"), r6("area"), "confidence", "height")


@query("delineated_parcels", """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 9), top AS (SELECT max(k // 50) + 1 AS n FROM p),
c AS (SELECT i.i + 50 * j.j AS k FROM (SELECT unnest(generate_series(0, 49)) AS i) i, (SELECT unnest(generate_series(0, (SELECT n - 1 FROM top))) AS j) j),
d AS (SELECT c.k, p.k IS NOT NULL AND c.k % 7 = 0 AS cut, p.k IS NOT NULL AND c.k % 5 = 0 AS house, p.k IS NOT NULL AND c.k % 17 = 0 AS road FROM c LEFT JOIN p USING (k)),
f AS (SELECT 400::DOUBLE AS area, 80::DOUBLE AS perimeter, house::INTEGER AS buildings FROM d WHERE NOT cut AND NOT road
  UNION ALL SELECT 200, 40 + sqrt(800), house::INTEGER FROM d WHERE cut UNION ALL SELECT 200, 40 + sqrt(800), 0 FROM d WHERE cut AND NOT road),
m AS (SELECT *, 4 * pi() * area / (perimeter * perimeter) AS compact FROM f), s AS (SELECT *, least(0.95::DOUBLE, greatest(0.5::DOUBLE, 0.7::DOUBLE * compact + CASE WHEN buildings > 0 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END)) AS conf FROM m)
SELECT round(area, 2) AS area, round(perimeter, 2) AS perimeter, round(compact, 4) AS compactness, buildings::BIGINT AS buildings, round(conf, 4) AS confidence, conf < 0.65::DOUBLE AS needs_gt FROM s""")
def delineated_parcels(spark, sf_dir):
    """Parcels from a network with diagonals and dead ends: faces that are mostly road go, houses count where they lie."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k")).where("k % 10 <> 9")
    x, y = ((F.col("k") % 50) * 20).cast("double"), (F.floor(F.col("k") / 50) * 20).cast("double")
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    block = lambda a, b, c, d: F.array(F.array(at(a, b), at(c, b), at(c, d), at(a, d)))
    houses = p.where("k % 5 = 0").select(F.col("k").alias("id"), block(8, 2, 12, 4).alias("rings"))
    # Two strips that overlap cover seven tenths of a cell, and of its upper half nine tenths or so.
    roads = p.where("k % 17 = 0").select(F.col("k").alias("line"), F.explode(F.array(block(0, 0, 10, 20), block(5, 0, 14, 20))).alias("rings"))
    found = delineation.delineated(network_lines(spark, sf_dir), 20.0, roads, houses)
    return found.select("area", "perimeter", "compactness", "buildings", "confidence", "needs_gt")
