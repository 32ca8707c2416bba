"""Map algebra over pixel relations ``row, col, v`` (null: no data).

Neighbourhoods are window frames along rows and along columns: two shuffles, no copies of pixels, and
every task holds one line of the raster. All operators keep other columns out: pass ``keys`` for a
raster or band id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plotline.functions.projection import lonlat_to_utm, utm_to_lonlat
from plotline.operators.checkpoints import checkpointed, written


def _along(keys: list[str], axis: str) -> Window:
    other = "row" if axis == "col" else "col"
    return Window.partitionBy(*keys, other).orderBy(axis)


def gradient(df: DataFrame, value: str = "v", dx: float = 1.0, dy: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """``gx, gy``: central differences, one-sided at the edges; 0 where a line has one pixel."""
    def slope(axis: str, step: float) -> Column:
        w = _along(list(keys), axis)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), (after - here) / step).when(
            after.isNull(), (here - before) / step).otherwise((after - before) / (2.0 * step))

    return df.withColumn("gx", slope("col", dx)).withColumn("gy", slope("row", dy))


def slope_degrees(df: DataFrame, value: str = "v", dx: float = 1.0, dy: float = 1.0, keys: list[str] = ()) -> DataFrame:
    return gradient(df, value, dx, dy, keys).withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))).drop("gx", "gy")


def hillshade(df: DataFrame, value: str = "v", dx: float = 1.0, dy: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, keys: list[str] = ()) -> DataFrame:
    """Shaded relief from 0 to 255, before truncation to whole numbers."""
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    tilt = math.pi / 2 - F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    shade = math.sin(alt) * F.sin(tilt) + math.cos(alt) * F.cos(tilt) * F.cos(az - F.atan2(-F.col("gx"), F.col("gy")))
    scaled = F.least(F.greatest(shade * 255.0, F.lit(0.0)), F.lit(255.0))
    return gradient(df, value, dx, dy, keys).withColumn("shade", scaled).drop("gx", "gy")


def _block(df: DataFrame, value: str, keys: list[str], reach: int, clamp: bool) -> DataFrame:
    """``block``: the values within ``reach`` in both directions; edges repeat their pixel or are left out."""
    rows, cols = _along(list(keys), "col"), _along(list(keys), "row")
    steps = range(-reach, reach + 1)

    def take(c: str, w: Window, k: int) -> Column:
        found = F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) if k < 0 else F.col(c)
        if not clamp or k == 0:
            return found
        nearer = [F.lag(c, j).over(w) if k > 0 else F.lead(c, j).over(w) for j in range(abs(k) - 1, 0, -1)]
        return F.coalesce(found, *nearer, F.col(c))

    line = df.withColumn("line_", F.array(*[take(value, rows, k) for k in steps]))
    block = F.flatten(F.array_compact(F.array(*[take("line_", cols, k) for k in steps])))
    return line.withColumn("block", block).drop("line_")


def median_filter(df: DataFrame, value: str = "v", reach: int = 1, keys: list[str] = ()) -> DataFrame:
    """``value`` replaced by the median of its (2 reach + 1) squared block; borders repeat the edge pixel."""
    size = (2 * reach + 1) ** 2
    return _block(df, value, list(keys), reach, True).withColumn(value, F.get(F.array_sort("block"), F.lit(size // 2))).drop("block")


def dilate(df: DataFrame, value: str = "v", reach: int = 1, keys: list[str] = ()) -> DataFrame:
    """Largest value of the block; what lies outside the raster doesn't count."""
    return _block(df, value, list(keys), reach, False).withColumn(value, F.array_max("block")).drop("block")


def erode(df: DataFrame, value: str = "v", reach: int = 1, keys: list[str] = ()) -> DataFrame:
    """Smallest value of the block; what lies outside the raster doesn't count."""
    return _block(df, value, list(keys), reach, False).withColumn(value, F.array_min("block")).drop("block")


def opened_closed(df: DataFrame, value: str = "v", keys: list[str] = ()) -> DataFrame:
    """Opening, then closing by 3 x 3: specks and pinholes go."""
    opened = dilate(erode(df, value, 1, keys), value, 1, keys)
    return erode(dilate(opened, value, 1, keys), value, 1, keys)


def local_maxima(df: DataFrame, value: str = "v", reach: int = 2, least: float = 2.0, keys: list[str] = ()) -> DataFrame:
    """``peak``: whether a pixel is the largest of its block and above ``least``."""
    peaks = _block(df, value, list(keys), reach, False)
    return peaks.withColumn("peak", (F.col(value) == F.array_max("block")) & (F.col(value) > least)).drop("block")


def height_above_ground(dsm: DataFrame, dtm: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Surface less terrain: negative and low heights 0, then a 3 x 3 median; no data where either has none.

    Pixels that only one raster has are dropped, as rasters of unlike extent can't be compared.
    """
    d = F.greatest(F.col("v") - F.col("ground"), F.lit(0.0))
    joined = dsm.join(dtm.withColumnRenamed("v", "ground"), ["row", "col"])
    raw = joined.select("row", "col", (F.col("v").isNull() | F.col("ground").isNull()).alias("hole"), F.coalesce(F.when(d < minimum, 0.0).otherwise(d), F.lit(0.0)).alias("v"))
    smooth = median_filter(raw, "v")
    return smooth.select("row", "col", F.when(~F.col("hole"), F.col("v")).alias("v"))


#: Values of a group whose percentiles are taken in one buffer, and groups that are broadcast, at most.
BUFFERED, BROADCAST_GROUPS = 1 << 20, 100_000
BUCKETS = 4096


def percentiles(df: DataFrame, value: str, keys: list[str], chances: list[float], buffered: int = BUFFERED) -> tuple[DataFrame, bool]:
    """``keys, cuts``: exact interpolated percentiles of every group, and whether the groups are few.

    Groups of up to ``buffered`` values take Spark's own aggregate. Otherwise the wanted ranks are narrowed
    down by histograms of ``BUCKETS`` cells, each round within the cell that holds the rank, until all
    values there are equal; so no task holds a group. Nulls don't count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    stats = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    groups, most = stats.agg(F.count("*"), F.max("n")).first()
    few = groups <= BROADCAST_GROUPS
    if (most or 0) <= buffered:
        return rows.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, chances))).alias("cuts")), few
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(chances)])
    wanted = stats.select(*keys, "lo", "hi", F.explode(places).alias("w"))
    both = F.explode(F.array(F.floor("w.at"), F.ceil("w.at")))
    spots = checkpointed(wanted.select(*keys, "lo", "hi", both.alias("rank")).distinct().withColumn("rest", F.col("rank")))
    at = Window.partitionBy(*keys, "rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        open_ = spots.where("lo < hi")
        if not open_.head(1):
            break
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1)).alias("cell")
        inside = rows.join(F.broadcast(open_) if few else open_, keys).where("v between lo and hi")
        counts = inside.groupBy(*keys, "rank", "rest", cell).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = counts.withColumn("upto", F.sum("c").over(at)).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("c") <= F.col("rest")))
        narrowed = found.select(*keys, "lo", "hi", "rank", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest"))
        spots = checkpointed(spots.where("lo = hi").unionByName(narrowed))
    low, high = (wanted.withColumn("rank", f("w.at")).join(spots.select(*keys, "rank", F.col("lo").alias(name)), [*keys, "rank"]).select(*keys, "w", name) for f, name in ((F.floor, "low"), (F.ceil, "high")))
    part = F.col("w.at") - F.floor("w.at")
    cut = F.when(part == 0, F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    cuts = low.join(high, [*keys, "w"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("w.i", cut.alias("v")))).alias("c"))
    return cuts.select(*keys, F.transform("c", lambda c: c["v"]).alias("cuts")), few


def stretch(df: DataFrame, value: str = "v", keys: list[str] = (), low: float = 0.02, high: float = 0.98, flat: float = 1e-5, buffered: int = BUFFERED) -> DataFrame:
    """``stretched``: values between two percentiles of the valid pixels as 0 to 1; no data and flat bands 0."""
    keys = list(keys) or ["one"]
    rows = df if keys != ["one"] else df.withColumn("one", F.lit(1))
    cuts, few = percentiles(rows, value, keys, [low, high], buffered)
    span = F.get("cuts", F.lit(1)) - F.get("cuts", F.lit(0))
    scaled = F.least(F.greatest((F.col(value) - F.get("cuts", F.lit(0))) / span, F.lit(0.0)), F.lit(1.0))
    joined = rows.join(F.broadcast(cuts) if few else cuts, keys, "left")
    return joined.withColumn("stretched", F.when(F.col(value).isNull() | (span < flat) | span.isNull(), 0.0).otherwise(scaled)).drop("cuts", "one")


def equalised(df: DataFrame, width: int, height: int, value: str = "v", grid: int = 8, clip: float = 2.0) -> DataFrame:
    """``value`` (0 to 1) with its contrast equalised in a grid of cells, clipped histograms blended between cells.

    Values are cut to 256 levels. A cell's histogram is clipped at ``clip`` times its mean and the excess
    dealt over all levels; its running sum maps levels to levels. A pixel takes the maps of the four
    nearest cells, weighted by distance. A raster that cells don't divide is mirrored at its far edges. The
    maps are grid * grid rows of 256 levels, whatever the raster's size, and are broadcast.
    """
    wide, high = -(-width // grid), -(-height // grid)
    area = wide * high
    limit = max(1, int(clip * area / 256))
    level = F.floor(F.col(value) * 255).cast("int")
    mirrored = lambda c, n, whole: F.explode(F.when((2 * n - 2 - F.col(c)).between(n, whole - 1), F.array(F.col(c), 2 * n - 2 - F.col(c))).otherwise(F.array(c)))
    spread = df.where(F.col(value).isNotNull()).select(level.alias("u"), mirrored("row", height, high * grid).alias("row"), "col").select("u", "row", mirrored("col", width, wide * grid).alias("col"))
    counts = spread.groupBy(F.floor(F.col("row") / high).cast("int").alias("ty"), F.floor(F.col("col") / wide).cast("int").alias("tx"), "u").agg(F.count("*").alias("n"))
    cells = counts.groupBy("ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("u", "n"))).alias("h"), F.sum(F.greatest(F.col("n") - limit, F.lit(0))).alias("over"))
    bins = cells.select("ty", "tx", "over", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("u"), "h")
    left = F.col("over") % 256
    step = F.greatest(F.floor(256 / left), F.lit(1))
    extra = F.when((left > 0) & (F.col("u") % step == 0) & (F.floor(F.col("u") / step) < left), 1).otherwise(0)
    dealt = bins.withColumn("n", F.least(F.coalesce(F.try_element_at("h", F.col("u")), F.lit(0)), F.lit(limit)) + F.floor(F.col("over") / 256) + extra)
    upto = F.sum("n").over(Window.partitionBy("ty", "tx").orderBy("u"))
    maps = dealt.withColumn("to", F.least(F.rint(upto * (255.0 / area)), F.lit(255.0))).groupBy("ty", "tx").agg(F.transform(F.sort_array(F.collect_list(F.struct("u", "to"))), lambda x: x["to"]).alias("map"))
    y, x = F.col("row") / float(high) - 0.5, F.col("col") / float(wide) - 0.5
    clamp = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(grid - 1)).cast("int")
    placed = df.withColumns({"u_": level, "ya_": y - F.floor(y), "xa_": x - F.floor(x), "y1_": clamp(F.floor(y)), "y2_": clamp(F.floor(y) + 1), "x1_": clamp(F.floor(x)), "x2_": clamp(F.floor(x) + 1)})
    for ty in ("y1_", "y2_"):
        for tx in ("x1_", "x2_"):
            tap = maps.select(F.col("ty").alias(ty), F.col("tx").alias(tx), F.col("map").alias("map_"))
            placed = placed.join(F.broadcast(tap), [ty, tx], "left").withColumn(f"{ty}{tx}", F.get("map_", F.col("u_"))).drop("map_")
    blend = lambda ty: F.col(f"{ty}x1_") * (1 - F.col("xa_")) + F.col(f"{ty}x2_") * F.col("xa_")
    made = F.rint(blend("y1_") * (1 - F.col("ya_")) + blend("y2_") * F.col("ya_")) / 255.0
    return placed.select(*[made.alias(value) if c == value else F.col(c) for c in df.columns])


def padded(channels: Column, n: int) -> Column:
    """An array of channels with zeros for those that are missing of n."""
    return F.concat(channels, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(channels), F.lit(0))))


def excess_green(df: DataFrame) -> DataFrame:
    """2 g - r - b of columns ``r, g, b``, stretched to 0 to 1."""
    return stretch(df.withColumn("exg_", 2.0 * F.col("g") - F.col("r") - F.col("b")), "exg_").withColumnRenamed("stretched", "exg").drop("exg_")


def overviews(df: DataFrame, levels: int, value: str = "v", keys: list[str] = ()) -> DataFrame:
    """``level, row, col`` and ``value``: the raster at 1 / 2 ** level of its resolution, by means, for levels from 1 on.

    Partial blocks at the edges average what they have, and no data counts nowhere. A level is made from the
    sums and counts of the one before, which are written, so the raster is read once.
    """
    known = F.col(value).isNotNull()
    current = df.select(*keys, "row", "col", F.col(value).cast("double").alias("s"), known.cast("long").alias("n"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    found = None
    for level in range(1, levels + 1):
        current = checkpointed(current.groupBy(*keys, half("row"), half("col")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
        part = current.select(F.lit(level).alias("level"), *keys, "row", "col", F.try_divide("s", "n").alias(value))
        found = part if found is None else found.unionByName(part)
    return found


def _lower_envelope(at: np.ndarray, heights: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """The least of (x - at)^2 + height over all parabolas, for each x of ``ask``; ``at`` ascends."""
    kept: list[int] = []
    starts: list[float] = []
    for k in range(len(at)):
        while True:
            if not kept:
                kept, starts = [k], [-np.inf]
                break
            j = kept[-1]
            meet = ((heights[k] + at[k] * at[k]) - (heights[j] + at[j] * at[j])) / (2 * (at[k] - at[j]))
            if meet > starts[-1]:
                kept.append(k)
                starts.append(meet)
                break
            kept.pop()
            starts.pop()
    lowest = np.array(kept)[np.searchsorted(starts, ask, side="right") - 1]
    return (ask - at[lowest]) ** 2 + heights[lowest]


def distance_transform(df: DataFrame, mask: str = "inside") -> DataFrame:
    """``distance`` of every pixel to the nearest pixel where ``mask`` is false; null where there is none.

    First along columns, by windows: the distance to the nearest such pixel above and below. Both run from an end
    of the column to the pixel, as a frame that begins at the pixel is computed anew for each one. Then along rows:
    the lower envelope of the parabolas that stand on these distances, in time linear in the row (Felzenszwalb and
    Huttenlocher, 2012). Tasks stream sorted rows and hold one raster line and a batch.
    """
    upto = (Window.unboundedPreceding, 0)
    up = Window.partitionBy("col").orderBy("row").rowsBetween(*upto)
    down = Window.partitionBy("col").orderBy(F.desc("row")).rowsBetween(*upto)
    zero = F.when(~F.col(mask), F.col("row"))
    near = df.withColumn("g_", F.least(F.col("row") - F.last(zero, True).over(up), F.last(zero, True).over(down) - F.col("row")).cast("double"))

    def measured(rows: pd.DataFrame) -> pd.DataFrame:
        line, at, high = rows["row"].to_numpy(), rows["col"].to_numpy(float), rows["g_"].to_numpy(float) ** 2
        found = np.full(len(rows), np.nan)
        ends = np.flatnonzero(line[1:] != line[:-1]) + 1
        for low, top in zip([0, *ends], [*ends, len(rows)], strict=True):
            site = ~np.isnan(high[low:top])
            if site.any():
                found[low:top] = np.sqrt(_lower_envelope(at[low:top][site], high[low:top][site], at[low:top]))
        return rows.drop(columns="g_").assign(distance=pd.Series(found, rows.index).astype(object).where(~np.isnan(found), None))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            last = rows["row"] == rows["row"].iloc[-1]
            held = rows[last]
            if not last.all():
                yield measured(rows[~last])
        if held is not None:
            yield measured(held)

    return near.repartition("row").sortWithinPartitions("row", "col").mapInPandas(lines, StructType([*df.schema.fields, StructField("distance", DoubleType())]))


def weighted_distance(distance: Column, height: Column) -> Column:
    """Distance times 1 to 3 by the height above ground over 10; null heights count as 0."""
    return distance * (1.0 + F.least(F.greatest(F.coalesce(height, F.lit(0.0)) / 10.0, F.lit(0.0)), F.lit(2.0)))


def bilinear(df: DataFrame, places: DataFrame, value: str = "v") -> DataFrame:
    """``row, col`` of ``places`` with ``value``: the raster at their ``y, x``, in pixels from the first centre, bilinear.

    Taps outside the raster or without data are left out and the others weigh more; where there is none, 0.
    """
    tap = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    taps = places.withColumn("t", tap).withColumn("fy", F.floor("y") + F.col("t.i")).withColumn("fx", F.floor("x") + F.col("t.j"))
    weight = (1 - F.abs(F.col("y") - F.col("fy"))) * (1 - F.abs(F.col("x") - F.col("fx")))
    source = df.select(F.col("row").cast("long").alias("fy"), F.col("col").cast("long").alias("fx"), F.col(value).alias("s"))
    joined = taps.withColumn("w", weight).join(source, ["fy", "fx"], "left")
    sums = joined.groupBy("row", "col").agg(F.sum(F.when(F.col("s").isNotNull(), F.col("w"))).alias("ws"), F.sum(F.col("w") * F.col("s")).alias("vs"))
    return sums.select("row", "col", F.coalesce(F.try_divide("vs", "ws"), F.lit(0.0)).alias(value))


def resampled(df: DataFrame, grid: DataFrame, scale: float, row0: float = 0.0, col0: float = 0.0, value: str = "v") -> DataFrame:
    """``grid`` (row, col) with ``value``: the raster resampled onto a master grid, bilinear between pixel centres.

    A grid pixel is ``scale`` raster pixels wide, and the grid begins at ``row0, col0`` of the raster.
    """
    y, x = ((F.col(c) + 0.5) * scale + start - 0.5 for c, start in (("row", row0), ("col", col0)))
    return bilinear(df, grid.select("row", "col", y.alias("y"), x.alias("x")), value)


def reprojected(df: DataFrame, grid: DataFrame, lon0: float, lat0: float, step: float, zone: int, x0: float, y0: float, gsd: float, value: str = "v", south: bool = False) -> DataFrame:
    """``grid`` (row, col) with ``value``: a UTM raster on a grid of degrees, bilinear.

    A grid pixel is ``step`` degrees wide, the grid begins at ``lon0, lat0`` (its upper left corner) and the raster at
    ``x0, y0`` with pixels of ``gsd`` metres. The centre of every grid pixel is projected to the raster; so each pixel
    has its value, and none is met twice.
    """
    lon, lat = lon0 + (F.col("col") + 0.5) * step, lat0 - (F.col("row") + 0.5) * step
    easting, northing = lonlat_to_utm(lon, lat, zone, south)
    return bilinear(df, grid.select("row", "col", ((y0 - northing) / gsd - 0.5).alias("y"), ((easting - x0) / gsd - 0.5).alias("x")), value)


def grid_of_degrees(df: DataFrame, zone: int, x0: float, y0: float, gsd: float, south: bool = False) -> tuple[float, float, float, int, int]:
    """``lon0, lat0, step, width, height`` of a grid of degrees around a UTM raster, with as many pixels along the diagonal.

    The bounds are those of the corners of all pixels on the raster's rim.
    """
    rim = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if rim[0] is None:
        return 0.0, 0.0, 1.0, 0, 0
    r0, r1, c0, c1 = rim[0], rim[1] + 1, rim[2], rim[3] + 1
    spark = df.sparkSession
    long, wide = spark.range(r0, r1 + 1).select(F.col("id").alias("r"), F.explode(F.array(F.lit(c0), F.lit(c1))).alias("c")), spark.range(c0, c1 + 1).select(F.explode(F.array(F.lit(r0), F.lit(r1))).alias("r"), F.col("id").alias("c"))
    lon, lat = utm_to_lonlat(x0 + F.col("c") * gsd, y0 - F.col("r") * gsd, zone, south)
    west, east, low, high = long.unionByName(wide).select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    step = math.hypot(east - west, high - low) / math.hypot(r1 - r0, c1 - c0)
    return west, high, step, math.ceil((east - west) / step - 1e-9), math.ceil((high - low) / step - 1e-9)


def neighbours(df: DataFrame) -> DataFrame:
    """Pairs of set pixels that share an edge, as ``src, dst`` pixel numbers (row * 2^32 + col)."""
    number = (F.col("row").cast("long") * F.lit(1 << 32) + F.col("col").cast("long")).alias("pixel")
    cells = df.select("row", "col", number)
    right = Window.partitionBy("row").orderBy("col")
    below = Window.partitionBy("col").orderBy("row")
    near = cells.withColumn("r", F.when(F.lead("col").over(right) == F.col("col") + 1, F.lead("pixel").over(right))).withColumn(
        "b", F.when(F.lead("row").over(below) == F.col("row") + 1, F.lead("pixel").over(below))
    )
    return near.select(F.col("pixel").alias("src"), F.explode(F.array_compact(F.array("r", "b"))).alias("dst"))


#: The eight neighbours of a pixel, clockwise from north, by their usual names.
AROUND = {"p2": (-1, 0), "p3": (-1, 1), "p4": (0, 1), "p5": (1, 1), "p6": (1, 0), "p7": (1, -1), "p8": (0, -1), "p9": (-1, -1)}


#: Rows and words of 64 pixels of a block that is thinned in one place, and steps that it takes there; no more than a word's pixels.
BLOCK_ROWS, BLOCK_WORDS, REACH = 256, 4, 64


def around(pixels: DataFrame) -> DataFrame:
    """``row, col, p2 ... p9``: for every set pixel which of its eight neighbours are set, as 0 or 1.

    Every pixel tells its neighbours and itself that it is there, in one aggregate.
    """
    steps = F.array(F.struct(F.lit("p1").alias("n"), F.lit(0).alias("i"), F.lit(0).alias("j")), *[F.struct(F.lit(n).alias("n"), F.lit(-i).alias("i"), F.lit(-j).alias("j")) for n, (i, j) in AROUND.items()])
    sent = pixels.select("row", "col", F.explode(steps).alias("a")).select((F.col("row") + F.col("a.i")).alias("row"), (F.col("col") + F.col("a.j")).alias("col"), "a.n")
    told = lambda n: F.coalesce(F.max(F.when(F.col("n") == n, 1)), F.lit(0)).alias(n)
    return sent.groupBy("row", "col").agg(told("p1"), *map(told, AROUND)).where("p1 = 1").drop("p1")


def _goes(grid: np.ndarray, step: int) -> np.ndarray:
    """Which pixels within a margin of one go in a step of the thinning."""
    height, width = grid.shape
    near = {n: grid[1 + i : height - 1 + i, 1 + j : width - 1 + j] for n, (i, j) in AROUND.items()}
    ring = list(AROUND)
    count = sum(near[p] for p in ring)
    turns = sum((near[q] > near[p]).view(np.uint8) for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
    a, b = (("p2", "p4", "p6"), ("p4", "p6", "p8")) if step == 0 else (("p2", "p4", "p8"), ("p2", "p6", "p8"))
    product = lambda t: near[t[0]] & near[t[1]] & near[t[2]]
    return (grid[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (product(a) == 0) & (product(b) == 0)


def _thinned(table: pa.Table) -> pa.Table:
    """Words of one block after ``REACH`` steps, and whether the block was still losing pixels at the last two."""
    rows, words, bits = (table.column(c).to_numpy() for c in ("row", "word", "bits"))
    own = (rows // BLOCK_ROWS == table.column("block")[0].as_py()) & (words // BLOCK_WORDS == table.column("across")[0].as_py())
    top, left = rows.min(), words.min()
    cells = np.zeros((rows.max() - top + 1, words.max() - left + 1, 64), np.uint8)
    cells[rows - top, words - left] = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    grid, idle, busy = np.pad(cells.reshape(len(cells), -1), 1), 0, False
    inside = np.zeros(cells.shape, bool)
    inside[rows[own] - top, words[own] - left] = True
    inside = inside.reshape(len(cells), -1)
    for step in range(REACH):
        goes = _goes(grid, step % 2)
        grid[1:-1, 1:-1][goes] = 0
        idle = 0 if goes.any() else idle + 1
        busy |= step >= REACH - 2 and bool((goes & inside).any())
        if idle == 2:
            break
    left_over = np.packbits(grid[1:-1, 1:-1].reshape(cells.shape), axis=2, bitorder="little").view(np.int64)[..., 0]
    rows, words = rows[own], words[own]
    return pa.table({"row": rows, "word": words, "bits": left_over[rows - top, words - left], "busy": np.full(len(rows), busy)})


def thin(df: DataFrame) -> DataFrame:
    """Skeleton of set pixels ``row, col`` by the two-step thinning of Zhang and Suen (1984).

    Each step looks at the eight neighbours and removes border pixels at once, until nothing goes. Pixels travel
    as words of 64 in a line. A block takes ``REACH`` steps with the ``REACH`` pixels around it, which is as far as
    they can tell, so that a round of Spark is that many steps; where no block loses pixels at its last two, all is done.
    """
    kinds = dict(df.dtypes)
    at = lambda name: F.col(name).cast("long")
    state = df.select(at("row").alias("row"), F.shiftright(at("col"), 6).alias("word"), F.expr("shiftleft(1L, cast(cast(col as bigint) & 63 as int))").alias("bit"))
    current = written(state.groupBy("row", "word").agg(F.bit_or("bit").alias("bits")))
    around_, busy = F.array(F.lit(-1), F.lit(0), F.lit(1)), True
    block, across = F.floor((F.col("row") + F.col("i") * REACH) / BLOCK_ROWS), F.floor((F.col("word") + F.col("j")) / BLOCK_WORDS)
    while busy:
        sent = current.where("bits <> 0").select("row", "word", "bits", F.explode(around_).alias("i")).select("*", F.explode(around_).alias("j"))
        seen = sent.select("row", "word", "bits", block.alias("block"), across.alias("across")).distinct()
        current = written(seen.groupBy("block", "across").applyInArrow(_thinned, "row long, word long, bits long, busy boolean"), current)
        busy = bool(current.where("busy").head(1))
    places = current.where("bits <> 0").select("row", "word", F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1)")).alias("i"))
    return places.select(F.col("row").cast(kinds["row"]).alias("row"), (F.col("word") * 64 + F.col("i")).cast(kinds["col"]).alias("col"))


def activation(logit: Column) -> Column:
    """Logistic function of a logit."""
    return 1.0 / (1.0 + F.exp(-logit))


def argmax(scores: Column) -> Column:
    """Position of the largest of an array, from 0, ties to the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pixel_to_world(row: Column, col: Column, x0: float, y0: float, gsd: float) -> tuple[Column, Column]:
    """Coordinates of a pixel's centre."""
    return x0 + (col + 0.5) * gsd, y0 - (row + 0.5) * gsd


def world_to_pixel(x: Column, y: Column, x0: float, y0: float, gsd: float) -> tuple[Column, Column]:
    """Row and column of the pixel that holds a point."""
    return F.floor((y0 - y) / gsd).cast("int"), F.floor((x - x0) / gsd).cast("int")
