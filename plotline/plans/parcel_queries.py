"""Queries over parcels, points and lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions.geometry import box_area, box_contains, box_perimeter, box_ring, polygon_area, ring_area, ring_boundary_distance, ring_bounds, ring_centroid, ring_contains, ring_length, rotated
from plotline.functions.overlay import ring_orthogonal, ring_rectangle, ring_shared_area, ring_simplified
from plotline.functions.projection import BETA, DELTA, FALSE_EASTING, RADIUS, SCALE, central_meridian, lonlat_to_utm, utm_to_lonlat
from plotline.operators import evaluation, faces, network, rasters_qc, survey, validation, zonal
from plotline.operators.checkpoints import dealt
from plotline.operators.spatial_join import meeting_pairs, nearest_box
from plotline.plans.relations import ENDPOINTS, PARCELS, POINTS, endpoints, parcels, points

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return add


SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
AREA = "(x1 - x0) * (y1 - y0)"
PAIRS = f"""pairs AS (
  SELECT *, CASE WHEN shared > 0 THEN shared / (area_a + area_b - shared) ELSE 0 END AS iou FROM (
    SELECT a.id AS a_id, b.id AS b_id, a.conf AS a_conf, b.conf AS b_conf, {SHARED} AS shared,
      (a.x1 - a.x0) * (a.y1 - a.y0) AS area_a, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_b
    FROM parcels a JOIN parcels b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1))"""
CONF = f"least(0.95::DOUBLE, greatest(0.5::DOUBLE, 0.7::DOUBLE * compact + 0.1::DOUBLE))"


@query("parcel_measures", f"""WITH {PARCELS}, m AS (
  SELECT *, {AREA} AS area, 2 * ((x1 - x0) + (y1 - y0)) AS per, 4 * pi() * {AREA} / pow(2 * ((x1 - x0) + (y1 - y0)), 2) AS compact FROM parcels)
SELECT id, round(area, 2) AS area_sqm, round(per, 2) AS perimeter_m, round(compact, 4) AS compactness, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy,
  greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) AS aspect, round({CONF}, 4) AS confidence, {CONF} < 0.65::DOUBLE AS needs_gt FROM m""")
def parcel_measures(spark, sf_dir):
    return validation.measures(parcels(spark, sf_dir))


@query("ring_measures", f"""WITH {PARCELS}
SELECT id, round({AREA}, 6) AS area, round(2 * ((x1 - x0) + (y1 - y0)), 6) AS length, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy,
  round({AREA}, 6) AS turned_area, round(least(x0 + 1 - x0, abs(x1 - x0 - 1), 1, abs(y1 - y0 - 1)), 6) AS to_border, x1 - x0 > 1 AND y1 - y0 > 1 AS holds
FROM parcels WHERE x1 - x0 > 1 AND y1 - y0 > 1""")
def ring_measures(spark, sf_dir):
    ring = F.col("ring")
    p = parcels(spark, sf_dir).where("x1 - x0 > 1 and y1 - y0 > 1").withColumn("ring", box_ring()).withColumn("c", ring_centroid(ring))
    x, y = F.col("x0") + 1.0, F.col("y0") + 1.0
    return p.select(
        "id", F.round(polygon_area(F.array(ring)), 6).alias("area"), F.round(ring_length(ring), 6).alias("length"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"),
        F.round(polygon_area(F.array(rotated(ring, F.lit(0.7), F.col("c")))), 6).alias("turned_area"), F.round(ring_boundary_distance(x, y, ring), 6).alias("to_border"),
        ring_contains(x, y, ring).alias("holds"),
    )


@query("overlap_pairs", f"WITH {PARCELS}, {PAIRS} SELECT a_id, b_id, shared FROM pairs WHERE shared > 0.05::DOUBLE")
def overlap_pairs(spark, sf_dir):
    return validation.overlap_pairs(validation.candidate_pairs(parcels(spark, sf_dir))).select("a_id", "b_id", "shared")


@query("duplicate_pairs", f"WITH {PARCELS}, {PAIRS} SELECT a_id, b_id, round(iou, 6) AS iou FROM pairs WHERE iou > 0.95::DOUBLE")
def duplicate_pairs(spark, sf_dir):
    return validation.duplicate_pairs(validation.candidate_pairs(parcels(spark, sf_dir))).select("a_id", "b_id", F.round("iou", 6).alias("iou"))


ISSUES = f"""issues AS (
  SELECT 2 AS rule, a_id AS first_id, b_id AS second_id, 'overlap' AS type, 'error' AS severity, a_id || ',' || b_id AS feature_ids,
    printf('overlap of %.2f sqm', round(shared, 2)) AS message, 'clip_overlap' AS auto_fix FROM pairs WHERE shared > 0.05::DOUBLE
  UNION ALL SELECT 3, a_id, b_id, 'duplicate', 'error', a_id || ',' || b_id, printf('IoU %.3f', round(iou, 3)), 'merge_duplicate' FROM pairs WHERE iou > 0.95::DOUBLE
  UNION ALL SELECT 4, id, NULL, 'sliver', 'warning', id::VARCHAR, printf('area of %.2f sqm', round({AREA}, 2)), 'merge_sliver' FROM parcels WHERE {AREA} < 4
  UNION ALL SELECT 5, id, NULL, 'shape_anomaly', 'warning', id::VARCHAR, printf('aspect of %.1f', round(greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0), 1)), 'review'
    FROM parcels WHERE greatest(x1 - x0, y1 - y0) > 12 * least(x1 - x0, y1 - y0))"""


@query("validation_issues", f"""WITH {PARCELS}, {PAIRS}, {ISSUES}
SELECT *, printf('issue_%d_%05d_%05d', rule, first_id, coalesce(second_id, 0)) AS issue_key FROM issues""")
def validation_issues(spark, sf_dir):
    return validation.issues(parcels(spark, sf_dir))


@query("validation_summary", f"""WITH {PARCELS}, {PAIRS}, {ISSUES}, n AS (SELECT count(*) AS total_parcels FROM parcels),
k AS (SELECT count(DISTINCT f) AS affected FROM (SELECT unnest(string_split(feature_ids, ',')) AS f FROM issues))
SELECT total_parcels, (SELECT count(*) FROM issues) AS total_issues, (SELECT count(*) FROM issues WHERE severity = 'error') AS n_error,
  (SELECT count(*) FROM issues WHERE severity = 'warning') AS n_warning, 0::BIGINT AS n_info, 0::BIGINT AS n_invalid,
  (SELECT count(*) FROM issues WHERE type = 'overlap') AS n_overlap, (SELECT count(*) FROM issues WHERE type = 'duplicate') AS n_duplicate,
  (SELECT count(*) FROM issues WHERE type = 'sliver') AS n_sliver, (SELECT count(*) FROM issues WHERE type = 'shape_anomaly') AS n_shape_anomaly,
  greatest(total_parcels - affected, 0) AS clean_parcels, round(greatest(total_parcels - affected, 0)::DOUBLE / greatest(total_parcels, 1) * 100, 2) AS clean_percentage
FROM n, k""")
def validation_summary(spark, sf_dir):
    p = parcels(spark, sf_dir)
    return validation.summary(p, validation.issues(p))


# Duplicates of this relation are disjoint pairs, for which the fold is a comparison.
@query("heal_duplicates", f"""WITH {PARCELS}, {PAIRS}, gone AS (
  SELECT CASE WHEN a_conf >= b_conf THEN b_id ELSE a_id END AS id FROM pairs WHERE iou > 0.95::DOUBLE)
SELECT id, conf FROM parcels WHERE id NOT IN (SELECT id FROM gone)""")
def heal_duplicates(spark, sf_dir):
    return validation.heal_duplicates(parcels(spark, sf_dir)).select("id", "conf")


@query("sliver_neighbours", f"""WITH {PARCELS}, m AS (
  SELECT *, {AREA} < 15 OR 4 * pi() * {AREA} / pow(2 * ((x1 - x0) + (y1 - y0)), 2) < 0.05::DOUBLE AS sliver FROM parcels), p AS (
  SELECT a.id, b.id AS n, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS w, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS h
  FROM m a JOIN m b ON a.sliver AND NOT b.sliver AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1), q AS (
  SELECT id, n, CASE WHEN w > 0 AND h > 0 THEN 2 * (w + h) ELSE w + h END AS border FROM p)
SELECT id, n AS neighbour, border AS shared_border FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY border DESC, n) AS r FROM q WHERE border > 0) WHERE r = 1""")
def sliver_neighbours(spark, sf_dir):
    return validation.sliver_neighbours(parcels(spark, sf_dir))


CUTS = f"""over AS (SELECT *, CASE WHEN a_conf >= b_conf THEN b_id ELSE a_id END AS id, CASE WHEN a_conf >= b_conf THEN a_id ELSE b_id END AS other FROM pairs WHERE shared > 0.05::DOUBLE),
cuts AS (SELECT p.id, greatest(p.x0, q.x0) AS x0, greatest(p.y0, q.y0) AS y0, least(p.x1, q.x1) AS x1, least(p.y1, q.y1) AS y1 FROM over o JOIN parcels p ON p.id = o.id JOIN parcels q ON q.id = o.other),
sides AS (SELECT id, x0, y0, x1, y1 FROM cuts UNION ALL SELECT id, x0, y0, x1, y1 FROM parcels WHERE id IN (SELECT id FROM cuts)),
xs AS (SELECT id, x AS lx, lead(x) OVER (PARTITION BY id ORDER BY x) AS hx FROM (SELECT id, x0 AS x FROM sides UNION SELECT id, x1 FROM sides)),
ys AS (SELECT id, y AS ly, lead(y) OVER (PARTITION BY id ORDER BY y) AS hy FROM (SELECT id, y0 AS y FROM sides UNION SELECT id, y1 FROM sides)),
left_ AS (SELECT id, sum((hx - lx) * (hy - ly)) AS area, count(*) AS cells FROM xs JOIN ys USING (id) WHERE hx IS NOT NULL AND hy IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.id = xs.id AND c.x0 <= lx AND c.x1 >= hx AND c.y0 <= ly AND c.y1 >= hy) GROUP BY id),
n AS (SELECT id, count(*) AS clips FROM cuts GROUP BY id)"""


@query("heal_overlaps", f"""WITH {PARCELS}, {PAIRS}, {CUTS}
SELECT id, coalesce(clips, 0) AS clips, round(coalesce(area, {AREA}), 6) AS area, coalesce(cells, 1) AS cells FROM parcels LEFT JOIN left_ USING (id) LEFT JOIN n USING (id)""")
def heal_overlaps(spark, sf_dir):
    found = validation.clipped_overlaps(parcels(spark, sf_dir))
    return found.select("id", "clips", F.round("area", 6).alias("area"), F.size("pieces").cast("long").alias("cells"))


@query("merge_slivers", f"""WITH {PARCELS}, m AS (
  SELECT *, {AREA} AS area, {AREA} < 15 OR 4 * pi() * {AREA} / pow(2 * ((x1 - x0) + (y1 - y0)), 2) < 0.05::DOUBLE AS sliver FROM parcels), p AS (
  SELECT a.id, b.id AS n, a.area, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS w, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS h
  FROM m a JOIN m b ON a.sliver AND NOT b.sliver AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1), q AS (
  SELECT id, n, area - w * h AS gained, CASE WHEN w > 0 AND h > 0 THEN 2 * (w + h) ELSE w + h END AS border FROM p), r AS (
  SELECT * FROM q WHERE border > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY border DESC, n) = 1), g AS (SELECT n AS id, sum(gained) AS gained, count(*) AS k FROM r GROUP BY n)
SELECT id, round(area + coalesce(gained, 0), 6) AS area, 1 + coalesce(k, 0) AS members FROM m LEFT JOIN g USING (id) WHERE NOT sliver
UNION ALL SELECT id, round(area, 6), 1 FROM m WHERE sliver AND area >= 5 AND id NOT IN (SELECT id FROM r)""")
def merge_slivers(spark, sf_dir):
    found = faces.merged_slivers(parcels(spark, sf_dir))
    return found.select("id", F.round("area", 6).alias("area"), F.size("members").cast("long").alias("members"))


def network_lines(spark, sf_dir):
    """The lines of the parcels' grid, diagonals of some cells, and dead ends in others."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k")).where("k % 10 <> 9")
    x, y = ((F.col("k") % 50) * 20).cast("double"), (F.floor(F.col("k") / 50) * 20).cast("double")
    cells = p.select("k", x.alias("x"), y.alias("y"))
    top = cells.agg((F.max("y") + 20.0).alias("top"))
    line = lambda df, ax, ay, bx, by: df.select(ax.cast("double").alias("ax"), ay.cast("double").alias("ay"), bx.cast("double").alias("bx"), by.cast("double").alias("by"))
    zero, wide, step = F.lit(0.0), F.lit(1000.0), F.col("i") * 20
    across = top.select(F.explode(F.sequence(F.lit(0), (F.col("top") / 20).cast("int"))).alias("i"))
    along = top.select("top", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("i"))
    diagonal, spur = cells.where("k % 7 = 0"), cells.where("k % 11 = 0 and k % 7 <> 0")
    found = line(across, zero, step, wide, step).unionByName(line(along, step, zero, step, F.col("top")))
    found = found.unionByName(line(diagonal, F.col("x"), F.col("y"), F.col("x") + 20, F.col("y") + 20)).unionByName(line(spur, F.col("x"), F.col("y"), F.col("x") + 6, F.col("y") + 3))
    return found.withColumn("line", F.xxhash64("ax", "ay", "bx", "by"))


@query("polygonised_faces", """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 9), top AS (SELECT max(k // 50) + 1 AS n FROM p),
c AS (SELECT i.i * 20 AS x0, j.j * 20 AS y0, i.i + 50 * j.j AS k FROM (SELECT unnest(generate_series(0, 49)) AS i) i, (SELECT unnest(generate_series(0, (SELECT n - 1 FROM top))) AS j) j),
d AS (SELECT c.*, p.k IS NOT NULL AND c.k % 7 = 0 AS cut FROM c LEFT JOIN p USING (k)), f AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE cut)
SELECT x0::DOUBLE AS x0, y0::DOUBLE AS y0, CASE WHEN cut THEN 200 ELSE 400 END::DOUBLE AS area, CASE WHEN cut THEN round(40 + sqrt(800), 6) ELSE 80 END::DOUBLE AS perimeter, CASE WHEN cut THEN 3 ELSE 4 END::BIGINT AS edges FROM f""")
def polygonised_faces(spark, sf_dir):
    """Lines noded at their crossings and closed to faces; dead ends bound nothing."""
    pieces = network.noded(network_lines(spark, sf_dir), 20.0)
    found = faces.polygonised(pieces, 5.0)
    return found.select("x0", "y0", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"), "edges")


def turned(spark, sf_dir, radians):
    """Parcels as rings, all turned about the origin, with their bounds."""
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    rings = parcels(spark, sf_dir).select("id", "conf", rotated(box_ring(), radians, origin).alias("ring")).withColumn("b", ring_bounds(F.col("ring")))
    return rings.select("id", "conf", "ring", "b.x0", "b.y0", "b.x1", "b.y1")


@query("ring_overlaps", f"WITH {PARCELS}, {PAIRS} SELECT a_id, b_id, round(shared, 6) AS shared, round(iou, 6) AS iou FROM pairs WHERE shared > 0.05::DOUBLE")
def ring_overlaps(spark, sf_dir):
    """Overlaps of rings in any position; turned together they share what the boxes share."""
    rings = turned(spark, sf_dir, F.lit(0.7))
    pairs = meeting_pairs(rings, rings, 40.0, F.col("a_id") < F.col("b_id"))
    found = pairs.withColumn("shared", ring_shared_area("a_ring", "b_ring")).where("shared > 0.05")
    # Turning leaves errors in the last digits, which go before the ratio is rounded.
    union = F.round(ring_area(F.col("a_ring")) + ring_area(F.col("b_ring")) - F.col("shared"), 9)
    return found.select("a_id", "b_id", F.round("shared", 6).alias("shared"), F.round(F.round("shared", 9) / union, 6).alias("iou"))


@query("ring_shapes", f"""WITH {PARCELS} SELECT id, round(least(x1 - x0, y1 - y0), 6) AS short, round(greatest(x1 - x0, y1 - y0), 6) AS long, 4::BIGINT AS vertices,
  round({AREA}, 6) AS simple_area, round({AREA}, 6) AS right_area FROM parcels""")
def ring_shapes(spark, sf_dir):
    """Smallest turned rectangle, simplification of rings with extra vertices, and right-angled rings."""
    rings = dealt(turned(spark, sf_dir, F.radians(F.col("id") % 180)))
    middle = lambda p, q: F.struct(((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))
    after = F.concat(F.slice("ring", 2, 3), F.slice("ring", 1, 1))
    dense = F.flatten(F.zip_with("ring", after, lambda p, q: F.array(p, middle(p, q))))
    made = rings.withColumn("r", ring_rectangle("ring")).withColumn("simple", ring_simplified(dense, 0.01)).withColumn("right", ring_orthogonal("ring"))
    return made.select(
        "id", F.round("r.short", 6).alias("short"), F.round("r.long", 6).alias("long"), F.size("simple").cast("long").alias("vertices"),
        F.round(ring_area(F.col("simple")), 6).alias("simple_area"), F.round(ring_area(F.col("right")), 6).alias("right_area"),
    )


@query("bbox_layer_filter", f"WITH {PARCELS} SELECT id, x0, y0, x1, y1 FROM parcels WHERE x0 <= 400 AND x1 >= 100 AND y0 <= 300 AND y1 >= 50")
def bbox_layer_filter(spark, sf_dir):
    return parcels(spark, sf_dir).where("x0 <= 400 and x1 >= 100 and y0 <= 300 and y1 >= 50").select("id", "x0", "y0", "x1", "y1")


@query("layer_bounds", f"""WITH {PARCELS} SELECT count(*) AS feature_count, coalesce(min(x0), 0) AS minx, coalesce(min(y0), 0) AS miny,
  coalesce(max(x1), 0) AS maxx, coalesce(max(y1), 0) AS maxy FROM parcels""")
def layer_bounds(spark, sf_dir):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return parcels(spark, sf_dir).agg(
        F.count("*").alias("feature_count"), z(F.min("x0")).alias("minx"), z(F.min("y0")).alias("miny"), z(F.max("x1")).alias("maxx"), z(F.max("y1")).alias("maxy")
    )


@query("bbox_overlap_ratio", f"""WITH {PARCELS}, {PAIRS} SELECT a_id, b_id, round(shared / least(area_a, area_b), 4) AS ratio FROM pairs""")
def bbox_overlap_ratio(spark, sf_dir):
    pairs = validation.candidate_pairs(parcels(spark, sf_dir))
    from plotline.functions.geometry import shared_area
    ratio = F.coalesce(F.try_divide(shared_area("a_", "b_"), F.least(box_area("a_"), box_area("b_"))), F.lit(0.0))
    return pairs.select("a_id", "b_id", F.round(ratio, 4).alias("ratio"))


@query("verification_list", f"""WITH {PARCELS}, p AS (SELECT id, conf, conf < 0.5::DOUBLE AS needs_gt, CASE WHEN id % 7 = 0 THEN 'disputed' WHEN id % 7 = 1 THEN NULL ELSE 'auto' END AS status FROM parcels)
SELECT *, '' AS surveyor_name, 'pending' AS field_verdict, '' AS boundary_notes, '' AS inspection_date FROM p WHERE conf < 0.65::DOUBLE OR needs_gt OR coalesce(status = 'disputed', false)""")
def verification_list(spark, sf_dir):
    status = F.when(F.col("id") % 7 == 0, "disputed").when(F.col("id") % 7 == 1, F.lit(None)).otherwise("auto")
    return validation.worklist(parcels(spark, sf_dir).select("id", "conf", (F.col("conf") < 0.5).alias("needs_gt"), status.alias("status")))


@query("contains_count", f"""WITH {PARCELS}, b AS (SELECT id, x0 + 1 AS x0, y0 + 1 AS y0, x0 + 5 AS x1, y0 + 5 AS y1 FROM parcels WHERE id % 3 = 0)
SELECT p.id, count(b.id) AS buildings_count FROM parcels p LEFT JOIN b ON p.x0 <= b.x0 AND p.y0 <= b.y0 AND b.x1 <= p.x1 AND b.y1 <= p.y1 GROUP BY p.id""")
def contains_count(spark, sf_dir):
    p = parcels(spark, sf_dir)
    b = p.where("id % 3 = 0").select("id", (F.col("x0") + 1).alias("x0"), (F.col("y0") + 1).alias("y0"), (F.col("x0") + 5).alias("x1"), (F.col("y0") + 5).alias("y1"))
    inside = meeting_pairs(p, b, 25.0).where(box_contains("a_", "b_")).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"))
    return p.select("id").join(inside, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("buildings_count"))


# Road bands of one kind don't overlap, so their areas add up.
@query("road_face_filter", f"""WITH {PARCELS}, r AS (SELECT k, 0::DOUBLE AS x0, k * 100 + 2::DOUBLE AS y0, 1100::DOUBLE AS x1, k * 100 + 16::DOUBLE AS y1 FROM (SELECT DISTINCT floor(y0 / 100) AS k FROM parcels)),
s AS (SELECT a.id, sum({SHARED}) AS road FROM parcels a JOIN r b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY a.id)
SELECT id, round(coalesce(road, 0) / ({AREA}), 6) AS road_share FROM parcels LEFT JOIN s USING (id) WHERE coalesce(road, 0) <= 0.5::DOUBLE * ({AREA})""")
def road_face_filter(spark, sf_dir):
    from plotline.functions.geometry import shared_area
    p = parcels(spark, sf_dir)
    k = p.select(F.floor(F.col("y0") / 100).cast("double").alias("k")).distinct()
    roads = k.select("k", F.lit(0.0).alias("x0"), (F.col("k") * 100 + 2).alias("y0"), F.lit(1100.0).alias("x1"), (F.col("k") * 100 + 16).alias("y1"))
    road = meeting_pairs(p, roads, 100.0).groupBy(F.col("a_id").alias("id")).agg(F.sum(shared_area("a_", "b_")).alias("road"))
    share = F.coalesce("road", F.lit(0.0)) / box_area()
    return p.join(road, "id", "left").withColumn("share", share).where("share <= 0.5").select("id", F.round("share", 6).alias("road_share"))


NEAREST = f"""best AS (
  SELECT q.seq, min({{'d': sqrt(pow(greatest(p.x0 - q.x, q.x - p.x1, 0), 2) + pow(greatest(p.y0 - q.y, q.y - p.y1, 0), 2)), 'id': p.id}}) AS m FROM points q, parcels p GROUP BY q.seq),
near AS (SELECT q.seq, q.d, p.id AS parcel, q.x, q.y, p.x0, p.y0, p.x1, p.y1, b.m.d AS distance FROM best b JOIN points q USING (seq) JOIN parcels p ON p.id = b.m.id),
matches AS (SELECT seq, parcel, CASE WHEN distance = 0 THEN least(x - x0, x1 - x, y - y0, y1 - y) ELSE distance END AS "offset" FROM near)"""


@query("nearest_parcel", f"WITH {PARCELS}, {POINTS}, {NEAREST} SELECT seq, parcel, round(\"offset\", 6) AS \"offset\" FROM matches")
def nearest_parcel(spark, sf_dir):
    return survey.matched_points(points(spark, sf_dir), parcels(spark, sf_dir)).withColumn("offset", F.round("offset", 6))


@query("gt_match", f"""WITH {POINTS}, m AS (SELECT seq, user_id AS parcel, d, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM points)
SELECT parcel, count(*) AS n_points, round(sum(CASE WHEN k = 1 THEN d / pow(2::DOUBLE, n - 1) ELSE d / pow(2::DOUBLE, n - k + 1) END), 6) AS gt_offset_m,
  CASE WHEN max(CASE WHEN k = n THEN d END) <= 0.5::DOUBLE THEN 'verified' ELSE 'disputed' END AS status FROM m GROUP BY parcel""")
def gt_match(spark, sf_dir):
    m = points(spark, sf_dir).select("seq", F.col("user_id").alias("parcel"), F.col("d").alias("offset"))
    return survey.folded_offsets(m).withColumn("gt_offset_m", F.round("gt_offset_m", 6))


@query("gt_metrics", f"""WITH {PARCELS}, {POINTS}, {NEAREST}, last AS (SELECT parcel, arg_max("offset", seq) AS o FROM matches GROUP BY parcel)
SELECT (SELECT count(*) FROM matches) AS total_gt_points, (SELECT round(avg("offset"), 3) FROM matches) AS mean_boundary_offset_m,
  (SELECT count(*) FROM last WHERE o <= 0.5::DOUBLE) AS verified_parcels_count""")
def gt_metrics(spark, sf_dir):
    m = survey.matched_points(points(spark, sf_dir), parcels(spark, sf_dir))
    return survey.offset_metrics(m, survey.folded_offsets(m))


@query("bridge_endpoints", f"""WITH {ENDPOINTS}, p AS (SELECT a.seq AS a_seq, b.seq AS b_seq, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance
FROM endpoints a JOIN endpoints b ON a.seq < b.seq AND a.line <> b.line AND abs(a.x - b.x) < 2.6::DOUBLE AND abs(a.y - b.y) < 2.6::DOUBLE)
SELECT a_seq, b_seq, round(distance, 6) AS distance FROM p WHERE distance > 0.05::DOUBLE AND distance <= 2.5::DOUBLE""")
def bridge_endpoints(spark, sf_dir):
    return network.bridges(endpoints(spark, sf_dir), digits=6).select("a_seq", "b_seq", "distance")


# Short lines spread over an area that grows with the table.
SEGMENTS = """segments AS (
  SELECT line, ax, ay, ax + CAST((line * 7) % 13 AS DOUBLE) - 6::DOUBLE AS bx, ay + CAST((line * 5) % 11 AS DOUBLE) - 5::DOUBLE AS "by" FROM (
    SELECT o_orderkey::BIGINT AS line, CAST((o_orderkey % 100) * 6 + o_orderkey % 7 AS DOUBLE) AS ax, CAST((o_orderkey // 100) * 6 + o_orderkey % 5 AS DOUBLE) AS ay FROM orders)
  WHERE (line * 7) % 13 <> 6 OR (line * 5) % 11 <> 5)"""


def segments(spark, sf_dir):
    k = F.col("line")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("line"))
    d = lambda c: c.cast("double")
    starts = o.where((k * 7 % 13 != 6) | (k * 5 % 11 != 5)).select("line", d((k % 100) * 6 + k % 7).alias("ax"), d(F.floor(k / 100) * 6 + k % 5).alias("ay"))
    return starts.select("line", "ax", "ay", (F.col("ax") + d(k * 7 % 13) - 6.0).alias("bx"), (F.col("ay") + d(k * 5 % 11) - 5.0).alias("by"))


@query("network_graph", f"""WITH {ENDPOINTS}, e AS (SELECT seq AS line, round(x, 0) AS ax, round(y / 10, 0) AS ay, round(y, 0) AS bx, round(x / 10, 0) AS cy FROM endpoints),
g AS (SELECT CASE WHEN [ax, ay] <= [bx, cy] THEN [ax, ay] ELSE [bx, cy] END AS p, CASE WHEN [ax, ay] <= [bx, cy] THEN [bx, cy] ELSE [ax, ay] END AS q, line FROM e),
u AS (SELECT p, q, max(line) AS line FROM g GROUP BY p, q), n AS (SELECT unnest([p, q]) AS node FROM u)
SELECT node[1] AS x, node[2] AS y, count(*) AS degree FROM n GROUP BY node""")
def network_graph(spark, sf_dir):
    e = endpoints(spark, sf_dir)
    s = e.select(F.col("seq").alias("line"), F.round("x", 0).alias("ax"), F.round(F.col("y") / 10, 0).alias("ay"), F.round("y", 0).alias("bx"), F.round(F.col("x") / 10, 0).alias("by"))
    return network.node_degrees(network.graph_edges(s))


CROSS = """cr AS (SELECT a.line AS a_line, b.line AS b_line, t, u, a.ax + t * (a.bx - a.ax) AS x, a.ay + t * (a.by - a.ay) AS y FROM (
  SELECT a, b, ((b.ax - a.ax) * (b.by - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / d AS t, ((b.ax - a.ax) * (a.by - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / d AS u FROM (
    SELECT a, b, (a.bx - a.ax) * (b.by - b.ay) - (a.by - a.ay) * (b.bx - b.ax) AS d FROM segments a JOIN segments b ON a.line < b.line
      AND abs(a.ax - b.ax) <= 12 AND abs(a.ay - b.ay) <= 10) WHERE d <> 0)
  WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


@query("segment_crossings", f"WITH {SEGMENTS}, {CROSS} SELECT a_line, b_line, round(x, 6) + 0 AS x, round(y, 6) + 0 AS y FROM cr")
def segment_crossings(spark, sf_dir):
    return network.crossings(segments(spark, sf_dir), 20.0).select("a_line", "b_line", (F.round("x", 6) + 0).alias("x"), (F.round("y", 6) + 0).alias("y"))


@query("noded_network", f"""WITH {SEGMENTS}, {CROSS}, cuts AS (SELECT a_line AS line, round(t, 9) AS t FROM cr UNION SELECT b_line, round(u, 9) FROM cr UNION SELECT line, unnest([0::DOUBLE, 1::DOUBLE]) FROM segments),
p AS (SELECT line, t, lead(t) OVER (PARTITION BY line ORDER BY t) AS e, row_number() OVER (PARTITION BY line ORDER BY t) - 1 AS piece FROM cuts)
SELECT line, piece::INTEGER AS piece, round(ax + t * (bx - ax), 6) + 0 AS ax, round(ay + t * ("by" - ay), 6) + 0 AS ay, round(ax + e * (bx - ax), 6) + 0 AS bx, round(ay + e * ("by" - ay), 6) + 0 AS "by"
FROM p JOIN segments USING (line) WHERE e IS NOT NULL""")
def noded_network(spark, sf_dir):
    """Every piece between two crossings of a line, with its ends."""
    pieces = network.noded(segments(spark, sf_dir), 20.0)
    return pieces.select("line", "piece", *[(F.round(c, 6) + 0).alias(c) for c in ("ax", "ay", "bx", "by")])


@query("spur_filter", f"WITH {SEGMENTS} SELECT line FROM segments WHERE sqrt(pow(bx - ax, 2) + pow(\"by\" - ay, 2)) >= 4")
def spur_filter(spark, sf_dir):
    return network.without_spurs(segments(spark, sf_dir), 4.0).select("line")


SHIFTED = "ref AS (SELECT id, x0 + 0.5::DOUBLE AS x0, y0, x1 + 0.5::DOUBLE AS x1, y1 FROM parcels WHERE id % 5 <> 0)"
MATCHES = f"""cand AS (SELECT a.id, b.id AS ref_id, {SHARED} AS s, (a.x1 - a.x0) * (a.y1 - a.y0) AS pa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ra
  FROM parcels a JOIN ref b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1), best AS (
  SELECT id, ref_id, s / (pa + ra - s) AS iou, abs(pa - ra) / greatest(ra, 1) AS area_error FROM cand
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY s / (pa + ra - s) DESC, ref_id) = 1), matched AS (SELECT * FROM best WHERE iou >= 0.5::DOUBLE)"""


def shifted(spark, sf_dir):
    return parcels(spark, sf_dir).where("id % 5 <> 0").withColumn("x0", F.col("x0") + 0.5).withColumn("x1", F.col("x1") + 0.5)


@query("evaluate_match", f"WITH {PARCELS}, {SHIFTED}, {MATCHES} SELECT id, ref_id, round(iou, 6) AS iou, round(area_error, 6) AS area_error FROM matched")
def evaluate_match(spark, sf_dir):
    m = evaluation.best_matches(parcels(spark, sf_dir), shifted(spark, sf_dir))
    return m.select("id", "ref_id", F.round("iou", 6).alias("iou"), F.round("area_error", 6).alias("area_error"))


@query("evaluate_accuracy", f"""WITH {PARCELS}, {SHIFTED}, {MATCHES}, n AS (SELECT count(*) AS n FROM parcels), r AS (SELECT count(*) AS m FROM ref)
SELECT n AS parcels_count, round(avg(iou), 6) AS mean_iou, round(count(DISTINCT ref_id) / any_value(m), 6) AS completeness, round(count(*) / n, 6) AS correctness,
  round(avg(area_error) * 100, 6) AS mean_area_error_pct, round(n * 0.225::DOUBLE, 6) AS manual_hours_saved, 10::DOUBLE AS efficiency_gain_factor FROM matched, n, r GROUP BY n""")
def evaluate_accuracy(spark, sf_dir):
    a = evaluation.parcel_accuracy(parcels(spark, sf_dir), shifted(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    saved, factor = evaluation.effort(F.col("parcels_count"))
    return a.select("parcels_count", r("mean_iou"), r("completeness"), r("correctness"), r("mean_area_error_pct"), F.round(saved, 6).alias("manual_hours_saved"), factor)


@query("landuse_histogram", """SELECT landuse, count(*) AS features FROM (SELECT coalesce(regexp_replace(lower(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE replace(p_type, ' ', '_') END), '_', ' '), 'other') AS landuse FROM part) GROUP BY landuse""")
def landuse_histogram(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return zonal.histogram(part.select(F.when(F.col("p_partkey") % 11 != 0, F.replace("p_type", F.lit(" "), F.lit("_"))).alias("landuse")), "landuse")


# Edits name the version 1 + (value's tenths); the fold needs recursion in SQL, so it is written as one.
@query("parcel_edits", """WITH RECURSIVE e AS (SELECT user_id::BIGINT AS parcel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 1 + event_id % 3 AS named FROM events),
f AS (SELECT parcel, 1::BIGINT AS k, CASE WHEN named = 1 THEN 2 ELSE 1 END::BIGINT AS version FROM e WHERE k = 1
  UNION ALL SELECT f.parcel, f.k + 1, CASE WHEN e.named = f.version THEN f.version + 1 ELSE f.version END FROM f JOIN e ON e.parcel = f.parcel AND e.k = f.k + 1)
SELECT parcel, max(k) AS n_edits, max(version) AS version, max(version) - 1 AS accepted FROM f GROUP BY parcel""")
def parcel_edits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("parcel"), "event_id", (1 + F.col("event_id") % 3).alias("named"))
    return survey.folded_edits(e, "parcel", "event_id", "named")


@query("qc_report", """WITH c AS (SELECT s_suppkey::BIGINT AS raster, CASE WHEN s_suppkey % 3 = 0 THEN 'ORI' WHEN s_suppkey % 3 = 1 THEN 'DSM' ELSE 'DTM' END AS type,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 4326 ELSE 32643 END AS epsg, 1 + s_suppkey % 4 AS bands, CAST(s_suppkey % 9 AS DOUBLE) / 20::DOUBLE AS gsd FROM supplier)
SELECT raster, type, array_to_string(list_filter([CASE WHEN epsg IS NULL THEN '[' || type || '] no CRS' END, CASE WHEN type = 'ORI' AND bands < 3 THEN '[ORI] fewer than 3 bands' END], lambda x: x IS NOT NULL), '; ') AS errors,
  array_to_string(list_filter([CASE WHEN epsg <> 32643 THEN '[' || type || '] not the project CRS' END, CASE WHEN gsd > 0.2::DOUBLE AND coalesce(epsg, 4326) <> 4326 THEN '[' || type || '] coarse pixels' END], lambda x: x IS NOT NULL), '; ') AS warnings,
  epsg IS NOT NULL AND NOT (type = 'ORI' AND bands < 3) AS is_valid FROM c""")
def qc_report(spark, sf_dir):
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("long").alias("raster"), F.when(k % 3 == 0, "ORI").when(k % 3 == 1, "DSM").otherwise("DTM").alias("type"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 7 == 0, 4326).otherwise(32643).alias("epsg"), (1 + k % 4).alias("bands"), (k % 9 / 20.0).alias("gsd"),
    )
    from plotline.operators.rasters_qc import admitted
    return admitted(s)


@query("control_points_rmse", "SELECT n_nationkey::INTEGER AS nation, round(sqrt(avg(pow(abs(s_acctbal) / 100, 2))), 6) AS rmse_m, sqrt(avg(pow(abs(s_acctbal) / 100, 2))) > 0.5::DOUBLE AS warns FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def control_points_rmse(spark, sf_dir):
    from plotline.operators.rasters_qc import rmse
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("cm", F.abs("s_acctbal").cast("double"))
    return joined.groupBy(F.col("n_nationkey").cast("int").alias("nation")).agg(rmse("cm").alias("r")).select("nation", F.round("r", 6).alias("rmse_m"), (F.col("r") > 0.5).alias("warns"))


def _projection_sql() -> str:
    xi_, eta_ = "xi", "eta"
    for j, b in enumerate(BETA, 1):
        xi_ += f" - ({b!r})::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
        eta_ += f" - ({b!r})::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
    lat = "chi" + "".join(f" + ({d!r})::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(DELTA, 1))
    return f"""WITH {POINTS}, p AS (SELECT seq, (2000000 + 100 * y) / {SCALE * RADIUS!r}::DOUBLE AS xi, ({FALSE_EASTING}::DOUBLE + 100 * x - {FALSE_EASTING}::DOUBLE) / {SCALE * RADIUS!r}::DOUBLE AS eta FROM points),
q AS (SELECT seq, {xi_} AS xi2, {eta_} AS eta2 FROM p), r AS (SELECT seq, eta2, xi2, asin(sin(xi2) / cosh(eta2)) AS chi FROM q)
SELECT seq, round({central_meridian(43)}::DOUBLE + degrees(atan2(sinh(eta2), cos(xi2))), 7) AS lon, round(degrees({lat}), 7) AS lat, true AS returns FROM r"""


@query("utm_to_wgs84", _projection_sql())
def utm_to_wgs84(spark, sf_dir):
    p = points(spark, sf_dir).select("seq", (FALSE_EASTING + 100 * F.col("x")).alias("e"), (2000000.0 + 100 * F.col("y")).alias("n"))
    lon, lat = utm_to_lonlat(F.col("e"), F.col("n"), 43)
    q = p.withColumn("lon", lon).withColumn("lat", lat)
    e, n = lonlat_to_utm(F.col("lon"), F.col("lat"), 43)
    return q.select("seq", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), ((F.abs(e - F.col("e")) < 1e-4) & (F.abs(n - F.col("n")) < 1e-4)).alias("returns"))


RASTERS = """c AS (SELECT s_suppkey // 3 AS site, ['ORI', 'DSM', 'DTM'][s_suppkey % 3 + 1] AS type, CASE WHEN s_suppkey % 7 = 0 THEN 101 ELSE 100 END AS w, 80 AS h,
  CASE WHEN s_suppkey % 11 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS x0 FROM supplier)"""


@query("misaligned_rasters", f"""WITH {RASTERS}, d AS (SELECT * FROM c WHERE type = 'DSM'), t AS (SELECT * FROM c WHERE type = 'DTM'), o AS (SELECT * FROM c WHERE type = 'ORI'),
e AS (SELECT d.site, CASE WHEN d.w <> t.w OR d.h <> t.h THEN 'models of unlike shape' WHEN d.x0 <> o.x0 THEN 'models not on the image''s grid' END AS error FROM d LEFT JOIN t USING (site) LEFT JOIN o ON o.site = d.site)
SELECT site::BIGINT AS site, error FROM e WHERE error IS NOT NULL""")
def misaligned_rasters(spark, sf_dir):
    """Sets of rasters whose models differ in shape or don't lie on the image's grid."""
    k = F.col("s_suppkey").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("ORI", "DSM", "DTM"))), (k % 3 + 1).cast("int"))
    catalog = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.floor(k / 3).alias("site"), k.alias("raster"), kind.alias("type"), F.when(k % 7 == 0, 101).otherwise(100).alias("w"), F.lit(80).alias("h"),
        F.when(k % 11 == 0, 0.5).otherwise(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.1).alias("gsd"),
    )
    return rasters_qc.misaligned(catalog, "site", "w", "h")


@query("boundary_network", f"""WITH {PARCELS}, e AS (SELECT x0 AS ax, y0 AS ay, x1 AS bx, y0 AS "by" FROM parcels UNION ALL SELECT x1, y0, x1, y1 FROM parcels),
g AS (SELECT a.x1 AS ax, a.y1 AS ay, b.x0 AS bx, b.y0 AS "by" FROM parcels a JOIN parcels b ON b.id = a.id + 1 AND b.y0 = a.y0)
SELECT DISTINCT ax, ay, bx, "by" FROM (SELECT * FROM e UNION ALL SELECT * FROM g UNION ALL SELECT x0, y0 - 1, x1, y0 - 1 FROM parcels WHERE id % 9 = 0) WHERE ay <> "by" OR ax <> bx""")
def boundary_network(spark, sf_dir):
    """Boundary segments, bridges and outlines of roads as one network without repeats."""
    p = parcels(spark, sf_dir)
    side = lambda df, ax, ay, bx, by: df.select(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    after = p.select((F.col("id") - 1).alias("id"), x0.alias("b_x"), y0.alias("b_y"))
    gaps = p.join(after, "id").where("b_y = y0").select(x1.alias("a_x"), y1.alias("a_y"), "b_x", "b_y")
    found = network.boundary_lines(side(p, x0, y0, x1, y0).unionByName(side(p, x1, y0, x1, y1)), gaps, side(p.where("id % 9 = 0"), x0, y0 - 1, x1, y0 - 1))
    return found.drop("line")
