"""Queries over pixel relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import evaluation, network, raster, tiling, zonal
from plotline.operators.components import connected_components
from plotline.plans.relations import PARCELS, PIXELS, parcels, pixels

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WIDTH = 64


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return add


def r6(c: str):
    return (F.round(c, 6) + 0.0).alias(c)


Z = f"{PIXELS}, z AS (SELECT row, col, 100 + 20 * v AS v FROM pixels)"
GRAD = """g AS (SELECT row, col, v, CASE WHEN l IS NULL THEN n - v WHEN n IS NULL THEN v - l ELSE (n - l) / 2 END AS gx, CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END AS gy
  FROM (SELECT *, lag(v) OVER (PARTITION BY row ORDER BY col) AS l, lead(v) OVER (PARTITION BY row ORDER BY col) AS n, lag(v) OVER (PARTITION BY col ORDER BY row) AS u, lead(v) OVER (PARTITION BY col ORDER BY row) AS d FROM z))"""


def surface(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("v", 100.0 + 20.0 * F.col("v"))


@query("slope_degrees", f"WITH {Z}, {GRAD} SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0 AS slope FROM g")
def slope_degrees(spark, sf_dir):
    return raster.slope_degrees(surface(spark, sf_dir)).select("row", "col", r6("slope"))


@query("hillshade", f"""WITH {Z}, {GRAD}, t AS (SELECT *, pi() / 2 - atan(sqrt(gx * gx + gy * gy)) AS tilt FROM g)
SELECT row, col, round(least(greatest(255 * (sin(radians(45)) * sin(tilt) + cos(radians(45)) * cos(tilt) * cos(radians(135) - atan2(-gx, gy))), 0), 255), 6) + 0 AS shade FROM t""")
def hillshade(spark, sf_dir):
    return raster.hillshade(surface(spark, sf_dir)).select("row", "col", r6("shade"))


def block_sql(relation: str, reach: int, agg: str, clamp: bool, name: str) -> str:
    """SQL of a neighbourhood aggregate by a join with the offsets."""
    if clamp:
        target = "ON q.row = least(greatest(p.row + i, lo_r), hi_r) AND q.col = least(greatest(p.col + j, lo_c), hi_c)"
    else:
        target = "ON q.row = p.row + i AND q.col = p.col + j"
    return f"""{name} AS (SELECT p.row, p.col, {agg} AS v FROM {relation} p, (SELECT min(row) AS lo_r, max(row) AS hi_r, min(col) AS lo_c, max(col) AS hi_c FROM {relation}) e,
  (SELECT unnest(generate_series(-{reach}, {reach}))::INTEGER AS i) a, (SELECT unnest(generate_series(-{reach}, {reach}))::INTEGER AS j) b JOIN {relation} q {target} GROUP BY p.row, p.col)"""


@query("median_filter_3x3", f"WITH {PIXELS}, {block_sql('pixels', 1, 'median(q.v)', True, 'm')} SELECT row, col, v FROM m")
def median_filter_3x3(spark, sf_dir):
    return raster.median_filter(pixels(spark, sf_dir))


@query("ndsm", f"""WITH {PIXELS}, h AS (SELECT row, col, row % 50 = 7 AND col < 5 AS hole, greatest(20 * v, 0) AS d FROM pixels),
c AS (SELECT row, col, hole, CASE WHEN hole OR d < 0.5::DOUBLE THEN 0 ELSE d END AS v FROM h), {block_sql('c', 1, 'median(q.v)', True, 'm')}
SELECT row, col, CASE WHEN NOT hole THEN round(m.v, 6) + 0 END AS v FROM m JOIN c USING (row, col)""")
def ndsm(spark, sf_dir):
    p = pixels(spark, sf_dir)
    dsm = p.withColumn("v", F.when(~((F.col("row") % 50 == 7) & (F.col("col") < 5)), 20.0 * F.col("v")))
    return raster.height_above_ground(dsm, p.withColumn("v", F.lit(0.0))).select("row", "col", r6("v"))


RGB = f"{PIXELS}, b AS (SELECT row, col, 100 + 50 * v AS r, 120 + 80 * v * v AS g, 90 - 30 * v AS b FROM pixels)"


def bands(spark, sf_dir):
    v = F.col("v")
    return pixels(spark, sf_dir).select("row", "col", (100.0 + 50.0 * v).alias("r"), (120.0 + 80.0 * v * v).alias("g"), (90.0 - 30.0 * v).alias("b"))


@query("excess_green", f"""WITH {RGB}, e AS (SELECT row, col, 2 * g - r - b AS e FROM b), c AS (SELECT quantile_cont(e, 0.02) AS lo, quantile_cont(e, 0.98) AS hi FROM e)
SELECT row, col, round(least(greatest((e - lo) / (hi - lo), 0), 1), 6) AS exg FROM e, c""")
def excess_green(spark, sf_dir):
    return raster.excess_green(bands(spark, sf_dir)).select("row", "col", r6("exg"))


@query("percentile_stretch", f"""WITH {RGB}, s AS (SELECT row, col, unnest(['r', 'g', 'b']) AS band, unnest([r, g, b]) AS v FROM b), c AS (SELECT band, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM s GROUP BY band)
SELECT row, col, band, round(least(greatest((v - lo) / (hi - lo), 0), 1), 6) AS stretched FROM s JOIN c USING (band)""")
def percentile_stretch(spark, sf_dir):
    b = bands(spark, sf_dir)
    stack = b.select("row", "col", F.explode(F.create_map(F.lit("r"), "r", F.lit("g"), "g", F.lit("b"), "b")).alias("band", "v"))
    return raster.stretch(stack, "v", ["band"]).select("row", "col", "band", r6("stretched"))


@query("feature_stack", f"""WITH {RGB} SELECT row, col, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, CASE WHEN row % 3 = 0 THEN 0 ELSE round((r - g) / 2, 6) END AS ndsm, r < 90 OR g < 120.1::DOUBLE AS hole FROM b""")
def feature_stack(spark, sf_dir):
    b = bands(spark, sf_dir)
    height = b.where("row % 3 <> 0").select("row", "col", ((F.col("r") - F.col("g")) / 2).alias("ndsm"))
    return b.join(height, ["row", "col"], "left").select("row", "col", r6("r"), r6("g"), r6("b"), F.coalesce(F.round("ndsm", 6), F.lit(0.0)).alias("ndsm"), ((F.col("r") < 90) | (F.col("g") < 120.1)).alias("hole"))


@query("overview_pyramid", f"WITH {PIXELS} " + " UNION ALL ".join(f"SELECT {k} AS level, (row // {1 << k})::INTEGER AS row, (col // {1 << k})::INTEGER AS col, round(avg(v), 6) + 0 AS v FROM pixels GROUP BY 2, 3" for k in (1, 2, 3, 4)))
def overview_pyramid(spark, sf_dir):
    return raster.overviews(pixels(spark, sf_dir), 4).select("level", "row", "col", r6("v"))




@query("tile_index", f"""WITH {PIXELS}, h AS (SELECT max(row) + 1 AS h FROM pixels), ro AS (SELECT DISTINCT least(g, h - 24) AS r0 FROM h, (SELECT unnest(generate_series(0, 2000000, 18)) AS g) WHERE g < h - 24 + 18),
co AS (SELECT unnest([0, 18, 36, 40]) AS c0), t AS (SELECT (row_number() OVER (ORDER BY r0, c0) - 1)::INTEGER AS tile_id, r0, c0 FROM ro, co)
SELECT tile_id, any_value(c0)::INTEGER AS col_off, any_value(r0)::INTEGER AS row_off, 500000 + any_value(c0) * 0.05::DOUBLE AS minx, 2000000 - any_value(r0) * 0.05::DOUBLE AS maxy, count(*) AS pixels, count(*) FILTER (v > 0.05::DOUBLE) AS set_pixels
FROM t JOIN pixels ON row BETWEEN r0 AND r0 + 23 AND col BETWEEN c0 AND c0 + 23 GROUP BY tile_id""")
def tile_index(spark, sf_dir):
    """Tiles over the raster with their place and the pixels that they hold."""
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("row")).first()[0] + 1
    placed = tiling.tiled_pixels(p, tiling.tiles(spark, WIDTH, height, 24, 0.25, 500000.0, 2000000.0, 0.05))
    return placed.groupBy("tile_id", "col_off", "row_off", "minx", "maxy").agg(F.count("*").alias("pixels"), F.count(F.when(F.col("v") > 0.05, 1)).alias("set_pixels"))


def stitch_sql(weight: str) -> str:
    return f"""WITH {PIXELS}, ro AS (SELECT DISTINCT least(g, (SELECT max(row) + 1 FROM pixels) - 24) AS r0 FROM (SELECT unnest(generate_series(0, 2000000, 18)) AS g) WHERE g < (SELECT max(row) + 1 FROM pixels) - 24 + 18),
co AS (SELECT unnest([0, 18, 36, 40]) AS c0), t AS (SELECT r0, c0 FROM ro, co), w AS (
  SELECT p.row, p.col, p.v + (c0 % 7) * 0.001::DOUBLE AS v, greatest({weight.format(k='(row - r0)')} * {weight.format(k='(col - c0)')}, 0.0001::DOUBLE) AS w
  FROM pixels p JOIN t ON row BETWEEN r0 AND r0 + 23 AND col BETWEEN c0 AND c0 + 23)
SELECT row, col, round(sum(w * v) / greatest(sum(w), 0.000001::DOUBLE), 6) + 0 AS v FROM w GROUP BY row, col"""


def stitch(spark, sf_dir, window):
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("row")).first()[0] + 1
    under = tiling.tiled_pixels(p, tiling.tiles(spark, WIDTH, height, 24, 0.25)).withColumn("v", F.col("v") + (F.col("col_off") % 7) * 0.001)
    return tiling.stitched(under, window).select("row", "col", r6("v"))


@query("tile_stitch_hann", stitch_sql("(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * {k} / 23))"))
def tile_stitch_hann(spark, sf_dir):
    return stitch(spark, sf_dir, "hann")


@query("tile_stitch_cosine", stitch_sql("cos(-pi() / 2 + pi() * {k} / 23)"))
def tile_stitch_cosine(spark, sf_dir):
    return stitch(spark, sf_dir, "cosine")


@query("training_chips", f"""WITH {PIXELS}, h AS (SELECT max(row) + 1 AS h FROM pixels), c AS (SELECT a.o AS col_off, b.o AS row_off, h FROM (SELECT unnest(generate_series(0, 48, 8)) AS o) a, h, (SELECT unnest(generate_series(0, 200000, 8)) AS o) b WHERE b.o <= h - 16),
s AS (SELECT col_off, row_off, any_value(h) AS h, avg((v < 0.02::DOUBLE)::INT) AS share FROM c JOIN pixels ON row BETWEEN row_off AND row_off + 15 AND col BETWEEN col_off AND col_off + 15 GROUP BY col_off, row_off)
SELECT col_off, row_off, round(share, 6) AS share_empty, CASE WHEN (col_off + 8) / 64 < 0.7::DOUBLE THEN 'train' WHEN (row_off + 8) / h < 0.5::DOUBLE THEN 'val' ELSE 'test' END AS split FROM s WHERE share <= 0.6::DOUBLE""")
def training_chips(spark, sf_dir):
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("row")).first()[0] + 1
    return tiling.chips(p, WIDTH, height, 16, 8, F.col("v") < 0.02, 0.6).select(F.col("col_off").cast("long"), F.col("row_off").cast("long"), r6("share_empty"), "split")


ZONES = f"{PIXELS}, zones AS (SELECT row // 10 AS zone, floor(20 * abs(v))::BIGINT AS class, v FROM pixels)"
MAJ = "n AS (SELECT zone, class, count(*) AS n FROM zones GROUP BY zone, class), maj AS (SELECT zone, class, n / sum(n) OVER (PARTITION BY zone) AS share, row_number() OVER (PARTITION BY zone ORDER BY n DESC, class) AS r FROM n)"


def zones(spark, sf_dir):
    return pixels(spark, sf_dir).select(F.floor(F.col("row") / 10).alias("zone"), F.floor(20 * F.abs("v")).alias("class"), "v")


@query("zonal_majority", f"WITH {ZONES}, {MAJ} SELECT zone, class, round(share, 6) AS share FROM maj WHERE r = 1")
def zonal_majority(spark, sf_dir):
    return zonal.majority(zones(spark, sf_dir), "zone", "class").select("zone", "class", r6("share"))


@query("zonal_median", f"WITH {ZONES} SELECT zone, round(median(v), 6) + 0 AS height FROM zones GROUP BY zone")
def zonal_median(spark, sf_dir):
    return zones(spark, sf_dir).groupBy("zone").agg(F.median("v").alias("height")).select("zone", r6("height"))


NAME = "CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in zonal.CLASSES.items()) + " ELSE 'residential' END"


@query("landuse_refine", f"""WITH {ZONES}, {MAJ}, h AS (SELECT zone, 4 + 100 * median(v) AS h FROM zones GROUP BY zone), m AS (SELECT zone, {NAME.format(c='((class + zone) % 10)')} AS name, share, h FROM maj JOIN h USING (zone) WHERE r = 1)
SELECT zone, CASE WHEN h > 3.5::DOUBLE AND name IN ('vegetation', 'water', 'open_land') THEN 'residential' WHEN h < 0.3::DOUBLE AND name IN ('commercial', 'institutional') THEN 'open_land' ELSE name END AS landuse,
  round(CASE WHEN h > 3.5::DOUBLE AND name IN ('vegetation', 'water', 'open_land') THEN greatest(share, 0.75::DOUBLE) ELSE share END, 4) AS lu_confidence FROM m""")
def landuse_refine(spark, sf_dir):
    z = zones(spark, sf_dir)
    heights = z.groupBy("zone").agg((4 + 100 * F.median("v")).alias("h"))
    m = zonal.majority(z, "zone", "class").join(heights, "zone").withColumn("name", zonal.class_name((F.col("class") + F.col("zone")) % 10))
    name, conf = zonal.refined_landuse(F.col("name"), F.col("share"), F.col("h"))
    return m.select("zone", name.alias("landuse"), F.round(conf, 4).alias("lu_confidence"))


COVER = "px.col + 0.5::DOUBLE >= s.x0 AND px.col + 0.5::DOUBLE < s.x1 AND px.row + 0.5::DOUBLE >= s.y0 AND px.row + 0.5::DOUBLE < s.y1"


@query("rasterize_boxes", f"""WITH {PARCELS}, lines AS (SELECT *, unnest(generate_series(floor(y0)::INTEGER, ceil(y1)::INTEGER)) AS row FROM parcels),
px AS (SELECT *, unnest(generate_series(floor(x0)::INTEGER, ceil(x1)::INTEGER)) AS col FROM lines)
SELECT row::INTEGER AS row, col::INTEGER AS col, max(id) AS value FROM px WHERE {COVER.replace("s.", "").replace("px.", "")} GROUP BY row, col""")
def rasterize_boxes(spark, sf_dir):
    return zonal.rasterized(parcels(spark, sf_dir), "id", "id").withColumnRenamed("id", "value")


@query("building_sample", f"""WITH {PARCELS}, {PIXELS} SELECT s.id, p.row, p.col, p.v FROM parcels s JOIN pixels p ON p.row = floor((s.y0 + s.y1) / 2)::INTEGER AND p.col = floor((s.x0 + s.x1) / 2)::INTEGER""")
def building_sample(spark, sf_dir):
    row, col = raster.world_to_pixel((F.col("x0") + F.col("x1")) / 2, -(F.col("y0") + F.col("y1")) / 2, 0.0, 0.0, 1.0)
    s = parcels(spark, sf_dir).select("id", row.alias("row"), col.alias("col"))
    return s.join(pixels(spark, sf_dir).hint("merge"), ["row", "col"]).select("id", "row", "col", "v")


@query("zonal_pixels", f"WITH {PARCELS}, {PIXELS} SELECT s.id, count(*) AS pixels, round(median(px.v), 6) + 0 AS height FROM parcels s JOIN pixels px ON {COVER} GROUP BY s.id")
def zonal_pixels(spark, sf_dir):
    burned = zonal.burned(parcels(spark, sf_dir)).select("id", "row", "col")
    # Both sides are spelled out from small tables, by whose size Spark would broadcast them.
    return burned.join(pixels(spark, sf_dir).hint("merge"), ["row", "col"]).groupBy("id").agg(F.count("*").alias("pixels"), F.median("v").alias("height")).select("id", "pixels", r6("height"))


BIN = f"{PIXELS}, m AS (SELECT row, col, (v > 0.1::DOUBLE)::INTEGER AS v FROM pixels)"


def mask(spark, sf_dir):
    return pixels(spark, sf_dir).select("row", "col", (F.col("v") > 0.1).cast("int").alias("v"))


@query("binary_dilate", f"WITH {BIN}, {block_sql('m', 2, 'max(q.v)', False, 'd')} SELECT row, col, v FROM d")
def binary_dilate(spark, sf_dir):
    return raster.dilate(mask(spark, sf_dir), reach=2)


@query("morph_open_close", f"""WITH {BIN}, {block_sql('m', 1, 'min(q.v)', False, 'a')}, {block_sql('a', 1, 'max(q.v)', False, 'b')}, {block_sql('b', 1, 'max(q.v)', False, 'c')}, {block_sql('c', 1, 'min(q.v)', False, 'd')} SELECT row, col, v FROM d""")
def morph_open_close(spark, sf_dir):
    return raster.opened_closed(mask(spark, sf_dir))


@query("local_maxima", f"WITH {PIXELS}, {block_sql('pixels', 2, 'max(q.v)', False, 'd')} SELECT row, col, pixels.v = d.v AND pixels.v > 0.2::DOUBLE AS peak FROM pixels JOIN d USING (row, col)")
def local_maxima(spark, sf_dir):
    return raster.local_maxima(pixels(spark, sf_dir), least=0.2).select("row", "col", "peak")


@query("distance_transform", f"""WITH {PIXELS}, m AS (SELECT row, col, v > 0.05::DOUBLE AS inside FROM pixels),
g AS (SELECT row, col, min(g) AS g FROM (
  SELECT row, col, row - max(CASE WHEN NOT inside THEN row END) OVER (PARTITION BY col ORDER BY row) AS g FROM m UNION ALL
  SELECT row, col, min(CASE WHEN NOT inside THEN row END) OVER (PARTITION BY col ORDER BY row DESC) - row FROM m) GROUP BY row, col),
d AS (SELECT p.row, p.col, min(sqrt((p.col - q.col) * (p.col - q.col) + q.g * q.g)) AS d FROM m p JOIN g q ON q.row = p.row AND q.g IS NOT NULL GROUP BY p.row, p.col)
SELECT row, col, round(d, 6) AS distance, round(least(greatest(1 - d / 30, 0), 1), 6) AS closeness FROM d""")
def distance_transform(spark, sf_dir):
    m = pixels(spark, sf_dir).select("row", "col", (F.col("v") > 0.05).alias("inside"))
    d = raster.distance_transform(m)
    return d.select("row", "col", r6("distance"), F.round(F.least(F.greatest(1 - F.col("distance") / 30, F.lit(0.0)), F.lit(1.0)), 6).alias("closeness"))


@query("connected_components", f"""WITH RECURSIVE {PIXELS}, m AS (SELECT row, col, row * 64 + col AS id FROM pixels WHERE v > 0.05::DOUBLE),
reach AS (SELECT id, row, col, id AS root FROM m UNION SELECT m.id, m.row, m.col, r.root FROM reach r JOIN (SELECT unnest([-1, 0, 0, 1]) AS i, unnest([0, -1, 1, 0]) AS j) o ON true JOIN m ON m.row = r.row + o.i AND m.col = r.col + o.j),
lab AS (SELECT id, min(root) AS label FROM reach GROUP BY id) SELECT n AS size, count(*) AS components FROM (SELECT label, count(*) AS n FROM lab GROUP BY label) GROUP BY n""")
def connected_components_sizes(spark, sf_dir):
    m = pixels(spark, sf_dir).where("v > 0.05").select("row", "col")
    parts = connected_components(raster.neighbours(m))
    number = F.col("row").cast("long") * F.lit(1 << 32) + F.col("col").cast("long")
    labels = m.withColumn("node", number).join(parts, "node", "left").select(F.coalesce("component", "node").alias("label"))
    return labels.groupBy("label").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


# SQL is too slow for the rounds of thinning; the tests have a brute-force version.
@query("skeleton")
def skeleton(spark, sf_dir):
    return raster.thin(raster.dilate(mask(spark, sf_dir)).where("v = 1"))


@query("resampled", f"""WITH {PIXELS}, e AS (SELECT min(row) AS r0, max(row) AS r1 FROM pixels), g AS (SELECT row, col, (row + 0.5::DOUBLE) * 1.25::DOUBLE + 0.3::DOUBLE - 0.5::DOUBLE AS y, (col + 0.5::DOUBLE) * 1.25::DOUBLE - 0.6::DOUBLE - 0.5::DOUBLE AS x
  FROM (SELECT row, col FROM pixels WHERE row % 5 < 4 AND col % 5 < 4)), t AS (SELECT g.row, g.col, (1 - abs(y - p.row)) * (1 - abs(x - p.col)) AS w, p.v FROM g JOIN (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) o ON true
  JOIN pixels p ON p.row = floor(y) + i AND p.col = floor(x) + j), s AS (SELECT row, col, sum(w) AS ws, sum(w * v) AS vs FROM t GROUP BY row, col)
SELECT g.row, g.col, round(coalesce(vs / nullif(ws, 0), 0), 6) + 0 AS v FROM g LEFT JOIN s USING (row, col)""")
def resampled(spark, sf_dir):
    """The raster on a coarser grid that is shifted against it and reaches beyond it."""
    p = pixels(spark, sf_dir)
    return raster.resampled(p, p.where("row % 5 < 4 and col % 5 < 4").select("row", "col"), 1.25, 0.3, -0.6).select("row", "col", r6("v"))


# The nearest zero of each column first, then along the rows.
DISTANCE = """i AS (SELECT row, col, v, v > 0.05::DOUBLE AS inside FROM pixels),
g AS (SELECT row, col, min(g) AS g FROM (
  SELECT row, col, row - max(CASE WHEN NOT inside THEN row END) OVER (PARTITION BY col ORDER BY row) AS g FROM i UNION ALL
  SELECT row, col, min(CASE WHEN NOT inside THEN row END) OVER (PARTITION BY col ORDER BY row DESC) - row FROM i) GROUP BY row, col),
d AS (SELECT p.row, p.col, any_value(p.v) AS v, any_value(p.inside) AS inside, min(sqrt((p.col - q.col) * (p.col - q.col) + q.g * q.g)) AS d FROM i p JOIN g q ON q.row = p.row AND q.g IS NOT NULL GROUP BY p.row, p.col)"""


def distances(spark, sf_dir):
    """Distance of every pixel to the nearest one outside the mask, with its value."""
    p = pixels(spark, sf_dir)
    return raster.distance_transform(p.select("row", "col", "v", (F.col("v") > 0.05).alias("inside")))


@query("weighted_distance", f"""WITH {PIXELS}, {DISTANCE} SELECT row, col, round(d * (1 + least(greatest(20 * v / 10, 0), 2)), 6) + 0 AS weight FROM d""")
def weighted_distance(spark, sf_dir):
    """Distance to the mask's edge, weighted by a height."""
    d = distances(spark, sf_dir)
    return d.select("row", "col", raster.weighted_distance(F.col("distance"), 20 * F.col("v")).alias("weight")).select("row", "col", r6("weight"))


TWO = f"{PIXELS}, t AS (SELECT row, col, v > 0.1::DOUBLE AS p, v + 0.02::DOUBLE * (col % 3) > 0.1::DOUBLE AS t FROM pixels)"


def two_masks(spark, sf_dir):
    return pixels(spark, sf_dir).select("row", "col", (F.col("v") > 0.1).alias("p"), (F.col("v") + 0.02 * (F.col("col") % 3) > 0.1).alias("t"))


@query("segmentation_metrics", f"""WITH {TWO}, c AS (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM t),
q AS (SELECT *, (tp + 1e-6) / (tp + fp + 1e-6) AS pr, (tp + 1e-6) / (tp + fn + 1e-6) AS re FROM c) SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re + 1e-6), 6) AS f1, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou FROM q""")
def segmentation_metrics(spark, sf_dir):
    found = two_masks(spark, sf_dir).agg(*evaluation.confusion(F.col("p"), F.col("t")))
    return found.select(*[r6(c) for c in found.columns])


@query("boundary_f1", f"""WITH {TWO}, o AS (SELECT i.i, j.j FROM (SELECT unnest(generate_series(-2, 2)) AS i) i, (SELECT unnest(generate_series(-2, 2)) AS j) j),
n AS (SELECT t.*, row + i AS r, col + j AS c FROM t, o),
x AS (SELECT n.row, n.col, any_value(n.p) AS p, any_value(n.t) AS t, bool_or(q.t) AS nt, bool_or(q.p) AS np FROM n JOIN t q ON q.row = n.r AND q.col = n.c GROUP BY n.row, n.col),
s AS (SELECT (count(*) FILTER (p AND nt) + 1e-6) / (count(*) FILTER (p) + 1e-6) AS pr, (count(*) FILTER (t AND np) + 1e-6) / (count(*) FILTER (t) + 1e-6) AS re FROM x) SELECT round(2 * pr * re / (pr + re + 1e-6), 6) AS boundary_f1 FROM s""")
def boundary_f1(spark, sf_dir):
    return evaluation.boundary_f1(two_masks(spark, sf_dir), 2).select(r6("boundary_f1"))


@query("losses", f"""WITH {PIXELS}, l AS (SELECT 10 * v AS x, 1 / (1 + exp(-10 * v)) AS p, (col % 2)::DOUBLE AS t, [v, 2 * v, 0.1::DOUBLE] AS k, CASE WHEN col % 5 = 0 THEN -1 ELSE col % 3 END AS y FROM pixels)
SELECT round(1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1), 6) AS dice, round(1 - (sum(p * t) + 1) / (sum(p * t) + 0.3::DOUBLE * sum(p * (1 - t)) + 0.7::DOUBLE * sum((1 - p) * t) + 1), 6) AS tversky,
  round(avg((1 - t) * x + (1 + 4 * t) * (ln(1 + exp(-abs(x))) + greatest(-x, 0))), 6) AS bce, round(avg(abs(p - t)), 6) AS l1,
  round(avg(CASE WHEN y <> -1 THEN ln(exp(k[1]) + exp(k[2]) + exp(k[3])) - k[y + 1] END), 6) AS ce FROM l""")
def losses(spark, sf_dir):
    v = F.col("v")
    rows = pixels(spark, sf_dir).select(
        (10 * v).alias("x"), raster.activation(10 * v).alias("p"), (F.col("col") % 2).cast("double").alias("t"), F.array(v, 2 * v, F.lit(0.1)).alias("k"),
        F.when(F.col("col") % 5 == 0, -1).otherwise(F.col("col") % 3).alias("y"),
    )
    p, t = F.col("p"), F.col("t")
    found = rows.agg(
        evaluation.dice_loss(p, t).alias("dice"), evaluation.tversky_loss(p, t).alias("tversky"), evaluation.bce_loss(F.col("x"), t, 5.0).alias("bce"),
        evaluation.l1_loss(p, t).alias("l1"), evaluation.cross_entropy(F.col("k"), F.col("y")).alias("ce"),
    )
    return found.select(*[r6(c) for c in found.columns])


@query("activations", f"""WITH {PIXELS}, a AS (SELECT row, col, round(1 / (1 + exp(-v)), 6) AS p, [v, -v, 0.05::DOUBLE] AS s FROM pixels) SELECT row, col, p, (list_position(s, list_max(s)) - 1)::INTEGER AS label FROM a""")
def activations(spark, sf_dir):
    v = F.col("v")
    return pixels(spark, sf_dir).select("row", "col", F.round(raster.activation(v), 6).alias("p"), raster.argmax(F.array(v, -v, F.lit(0.05))).alias("label"))


@query("tta_mean", f"""WITH {PIXELS}, h AS (SELECT max(row) AS h FROM pixels), u AS (SELECT row, col, v FROM pixels UNION ALL SELECT row, 63 - col, v + 1 FROM pixels UNION ALL SELECT h - row, col, v - 2 FROM pixels, h)
SELECT row, col, round(avg(v), 6) + 0 AS v FROM u GROUP BY row, col""")
def tta_mean(spark, sf_dir):
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("row")).first()[0] + 1
    return evaluation.flipped_mean(p, WIDTH, height, p.withColumn("v", F.col("v") + 1), p.withColumn("v", F.col("v") - 2)).select("row", "col", r6("v"))


@query("lr_schedule", "SELECT doc_id % 50 AS epoch, count(*) AS samples, round(1e-6 + (3e-4 - 1e-6) * (1 + cos(pi() * (doc_id % 50) / 50)) / 2, 9) AS lr FROM labels GROUP BY doc_id % 50")
def lr_schedule(spark, sf_dir):
    """Learning rate of every epoch that labels are dealt to, and their number."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("doc_id") % 50).alias("epoch"))
    counts = labels.groupBy("epoch").agg(F.count("*").alias("samples"))
    return counts.select("epoch", "samples", F.round(evaluation.cosine_rate(F.col("epoch"), 50, 3e-4, 1e-6), 9).alias("lr"))


@query("best_checkpoint", "SELECT row_ AS epoch, f1 FROM (SELECT doc_id AS row_, CAST(doc_id % 37 AS DOUBLE) / 37::DOUBLE AS f1 FROM labels) ORDER BY f1 DESC, epoch LIMIT 1")
def best_checkpoint(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("epoch"), (F.col("doc_id") % 37 / 37.0).alias("f1"))
    return evaluation.best_epoch(labels)


LUT = f"""{PIXELS}, px AS (SELECT row, col, least(greatest(0.5::DOUBLE + 2 * v, 0), 1) AS v FROM pixels), e AS (SELECT max(row) + 1 AS h, ceil((max(row) + 1) / 8)::BIGINT AS th, 8::BIGINT AS tw FROM px),
m AS (SELECT floor(v * 255)::INTEGER AS u, row, col FROM px UNION ALL SELECT floor(v * 255)::INTEGER, 2 * h - 2 - row, col FROM px, e WHERE 2 * h - 2 - row BETWEEN h AND 8 * th - 1),
hist AS (SELECT row // th AS ty, col // tw AS tx, u, count(*) AS n FROM m, e GROUP BY ALL), lim AS (SELECT greatest(1, floor(2 * th * tw / 256)) AS k, th * tw AS area FROM e),
o AS (SELECT ty, tx, sum(greatest(n - k, 0))::BIGINT AS over FROM hist, lim GROUP BY ty, tx), b AS (SELECT o.*, g.u FROM o, (SELECT unnest(generate_series(0, 255)) AS u) g),
d AS (SELECT b.ty, b.tx, b.u, least(coalesce(n, 0), k) + over // 256 + CASE WHEN over % 256 > 0 AND b.u % greatest(256 // (over % 256), 1) = 0 AND b.u // greatest(256 // (over % 256), 1) < over % 256 THEN 1 ELSE 0 END AS n
  FROM b LEFT JOIN hist USING (ty, tx, u), lim), lut AS (SELECT ty, tx, u, least(round_even(sum(n) OVER (PARTITION BY ty, tx ORDER BY u) * (255::DOUBLE / area), 0), 255) AS v FROM d, lim)"""


@query("local_contrast", f"""WITH {LUT}, q AS (SELECT row, col, floor(v * 255)::INTEGER AS u, row / th - 0.5::DOUBLE AS y, col / tw - 0.5::DOUBLE AS x FROM px, e),
t AS (SELECT q.row, q.col, l.v * (CASE WHEN i = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN j = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS part
  FROM (SELECT * FROM q, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) o) q JOIN lut l ON l.u = q.u AND l.ty = least(greatest(floor(y) + i, 0), 7) AND l.tx = least(greatest(floor(x) + j, 0), 7))
SELECT row, col, round(round_even(round(sum(part), 9), 0) / 255, 6) AS v FROM t GROUP BY row, col""")
def local_contrast(spark, sf_dir):
    """Contrast equalised in an 8 by 8 grid of cells."""
    p = pixels(spark, sf_dir).withColumn("v", F.least(F.greatest(0.5 + 2 * F.col("v"), F.lit(0.0)), F.lit(1.0)))
    height = p.agg(F.max("row")).first()[0] + 1
    return raster.equalised(p, WIDTH, height).select("row", "col", r6("v"))


@query("chip_counts", f"""WITH {PIXELS}, h AS (SELECT max(row) + 1 AS h FROM pixels), c AS (SELECT a.o AS col_off, b.o AS row_off, h FROM (SELECT unnest(generate_series(0, 48, 8)) AS o) a, h, (SELECT unnest(generate_series(0, 200000, 8)) AS o) b WHERE b.o <= h - 16),
s AS (SELECT col_off, row_off, any_value(h) AS h, avg((v < 0.02::DOUBLE)::INT) AS share FROM c JOIN pixels ON row BETWEEN row_off AND row_off + 15 AND col BETWEEN col_off AND col_off + 15 GROUP BY col_off, row_off),
k AS (SELECT CASE WHEN (col_off + 8) / 64 < 0.7::DOUBLE THEN 'train' WHEN (row_off + 8) / h < 0.5::DOUBLE THEN 'val' ELSE 'test' END AS split FROM s WHERE share <= 0.6::DOUBLE)
SELECT split, (SELECT count(*) FROM k WHERE k.split = n.split) AS chips FROM (SELECT unnest(['train', 'val', 'test']) AS split) n""")
def chip_counts(spark, sf_dir):
    p = pixels(spark, sf_dir)
    height = p.agg(F.max("row")).first()[0] + 1
    return tiling.split_counts(tiling.chips(p, WIDTH, height, 16, 8, F.col("v") < 0.02, 0.6))


@query("class_pixel_counts", f"WITH {PIXELS} SELECT CAST(count(*) FILTER (v > 0.05::DOUBLE) AS BIGINT) AS building, CAST(count(*) FILTER (v < -0.05::DOUBLE) AS BIGINT) AS road, CAST(count(*) FILTER (col % 5 = 0 AND v > 0) AS BIGINT) AS boundary, count(*) AS pixels FROM pixels")
def class_pixel_counts(spark, sf_dir):
    """Set pixels per mask and all pixels."""
    v = F.col("v")
    masks = {"building": v > 0.05, "road": v < -0.05, "boundary": (F.col("col") % 5 == 0) & (v > 0)}
    return pixels(spark, sf_dir).agg(*[F.count(F.when(m, 1)).alias(n) for n, m in masks.items()], F.count("*").alias("pixels"))


@query("road_widths", f"""WITH {PIXELS}, {DISTANCE} SELECT row % 40 AS line, round(greatest(avg(2 * d * 0.5::DOUBLE), 1.5::DOUBLE), 6) AS width FROM d WHERE inside GROUP BY 1""")
def road_widths(spark, sf_dir):
    """Mean width of the mask along lines of pixels."""
    d = distances(spark, sf_dir).where("inside").select((F.col("row") % 40).alias("line"), "distance")
    return network.road_widths(d, 0.5).select("line", r6("width"))


@query("epoch_means", f"""WITH {PIXELS}, b AS (SELECT row // 50 AS epoch, row // 7 AS batch, avg(abs(v)) AS loss, sum(CASE WHEN v > 0 THEN v END) AS s, count(CASE WHEN v > 0 THEN v END) AS n FROM pixels GROUP BY ALL)
SELECT epoch::BIGINT AS epoch, round(avg(loss), 6) AS loss, round(sum(s) / sum(n), 6) AS iou FROM b GROUP BY epoch""")
def epoch_means(spark, sf_dir):
    """Losses by batch and scores by image, averaged per epoch."""
    images = pixels(spark, sf_dir).select(F.floor(F.col("row") / 50).alias("epoch"), F.floor(F.col("row") / 7).alias("batch"), F.abs("v").alias("loss"), F.when(F.col("v") > 0, F.col("v")).alias("iou"))
    found = evaluation.epoch_means(images, "epoch", "batch", "loss", ["iou"])
    return found.select("epoch", r6("loss"), r6("iou"))
