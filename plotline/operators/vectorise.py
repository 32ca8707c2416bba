"""Regions of a raster as polygons: boundary edges, straight runs, rings in order, holes under their shell.

All is done on relations of edges: no task holds a region, and a ring is gathered only as the row that it
becomes. Corners are grid points ``row, col`` of pixels' upper left corners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.operators.components import connected_components
from plotline.operators.checkpoints import written
from plotline.operators.ranking import ranked

#: Number of a pixel: row * 2^32 + col.
ROW = 1 << 32


def _beside(df: DataFrame, label: str) -> DataFrame:
    """``left, right, up, down``: labels of the four neighbours, null where there is none."""
    rows, cols = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    near = lambda step, axis, w: F.when(step(axis).over(w) == F.col(axis) + (1 if step is F.lead else -1), step(label).over(w))
    return df.withColumns({"left": near(F.lag, "col", rows), "right": near(F.lead, "col", rows), "up": near(F.lag, "row", cols), "down": near(F.lead, "row", cols)})


def regions(df: DataFrame, label: str = "label") -> DataFrame:
    """``row, col, label, region``: pixels of one label that hang together by their edges, under the smallest pixel number.

    Null labels are no regions. A pixel must be there once.
    """
    here = df.where(F.col(label).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), label)
    # Runs of a label along a row hang together under their first pixel; only runs that touch are edges.
    rows, cols = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    goes_on = F.coalesce((F.lag("col").over(rows) == F.col("col") - 1) & (F.lag(label).over(rows) == F.col(label)), F.lit(False))
    first = F.max(F.when(~F.col("goes_on"), F.col("col"))).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    runs = written(here.withColumn("goes_on", goes_on).withColumn("first", first).groupBy("row", "first").agg(F.max("col").alias("final"), F.min(label).alias(label)))
    spelled = runs.select("row", "first", F.explode(F.sequence("first", "final")).alias("col"), label)
    number = lambda row, col: row * F.lit(ROW) + col
    below = F.when((F.lead("row").over(cols) == F.col("row") + 1) & (F.lead(label).over(cols) == F.col(label)), number(F.lead("row").over(cols), F.lead("first").over(cols)))
    edges = spelled.select(number(F.col("row"), F.col("first")).alias("src"), below.alias("dst")).where("dst is not null")
    parts = connected_components(edges, cut=written)
    found = runs.withColumn("node", number(F.col("row"), F.col("first"))).join(parts, "node", "left")
    return found.select("row", F.explode(F.sequence("first", "final")).alias("col"), label, F.coalesce("component", "node").alias("region"))


def boundary_runs(pixels: DataFrame) -> DataFrame:
    """Straight runs of boundary with their region on the left: ``region, side, r0, c0, r1, c1, length``.

    ``side`` is the direction as seen on a map: 0 east, 1 north, 2 west, 3 south. Edges of pixels make a run
    while they are in one line; where a region meets itself at a corner only, lines end.
    """
    near = _beside(pixels, "region")
    differs = lambda c: F.col(c).isNull() | (F.col(c) != F.col("region"))
    edge = lambda side, line, at: F.struct(F.lit(side).alias("side"), line.alias("line"), at.alias("at"))
    r, c = F.col("row"), F.col("col")
    sides = F.array_compact(F.array(
        F.when(differs("down"), edge(0, r + 1, c)), F.when(differs("right"), edge(1, c + 1, r)), F.when(differs("up"), edge(2, r, c)), F.when(differs("left"), edge(3, c, r))
    ))
    edges = near.select("region", F.explode(sides).alias("e")).select("region", "e.*")
    along = Window.partitionBy("region", "side", "line").orderBy("at")
    runs = edges.withColumn("island", F.col("at") - F.row_number().over(along)).groupBy("region", "side", "line", "island").agg(F.min("at").alias("low"), (F.max("at") + 1).alias("high"))
    pick = lambda east, north, west, south: F.when(F.col("side") == 0, east).when(F.col("side") == 1, north).when(F.col("side") == 2, west).otherwise(south)
    line, low, high = F.col("line"), F.col("low"), F.col("high")
    return runs.select(
        "region", "side", pick(line, high, line, low).alias("r0"), pick(low, line, high, line).alias("c0"),
        pick(line, low, line, high).alias("r1"), pick(high, line, low, line).alias("c1"), (high - low).alias("length"),
    )


def ring_corners(pixels: DataFrame) -> DataFrame:
    """Corners of all rings in order: ``region, ring, seq, row, col, hole, length``; length is that of the run from there.

    At a corner where a region meets itself the boundary turns right, so that a hole that touches the
    outline stays a ring of its own. Shells run counter-clockwise on a map, holes clockwise.
    """
    runs = written(boundary_runs(pixels).withColumn("link", F.monotonically_increasing_id()))
    starts = runs.select("region", F.col("r0").alias("r1"), F.col("c0").alias("c1"), F.col("side").alias("turned"), F.col("link").alias("next"))
    turn = lambda by, name: runs.withColumn("turned", (F.col("side") + by) % 4).join(starts, ["region", "r1", "c1", "turned"]).select("link", F.col("next").alias(name))
    links = runs.select("link").join(turn(3, "right"), "link", "left").join(turn(1, "left"), "link", "left").select("link", F.coalesce("right", "left").alias("next"))
    placed = runs.join(ranked(links).select("link", F.col("chain").alias("ring"), "seq"), "link")
    # Rows count down, so the shoelace sum of columns and rows has the other sign than on a map.
    doubled = placed.groupBy("ring").agg((F.sum(F.col("c1") * F.col("r0") - F.col("c0") * F.col("r1")) < 0).alias("hole"))
    return placed.join(doubled, "ring").select("region", "ring", "seq", F.col("r0").alias("row"), F.col("c0").alias("col"), "hole", "length")


def polygons(corners: DataFrame, x0: float = 0.0, y0: float = 0.0, gsd: float = 1.0) -> DataFrame:
    """``region, rings, area, perimeter, holes``: the shell first, then the holes, as arrays of (x, y) on the map.

    The row of a region holds all its corners.
    """
    point = F.struct((x0 + F.col("col") * gsd).alias("x"), (y0 - F.col("row") * gsd).alias("y"))
    after = Window.partitionBy("ring").orderBy("seq")
    first = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = lambda c: F.coalesce(F.lead(c).over(after), F.first(c).over(first))
    cross = (F.col("row") * follow("col") - follow("row") * F.col("col")) / 2.0
    measured = corners.withColumn("p", point).withColumn("cross", cross)
    rings = measured.groupBy("region", "hole", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"]).alias("ring_"), F.sum("cross").alias("area"), F.sum("length").alias("length"))
    whole = rings.groupBy("region").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "ring_"))), lambda s: s["ring_"]).alias("rings"),
        (F.sum("area") * gsd * gsd).alias("area"), (F.sum("length") * gsd).alias("perimeter"), F.count(F.when(F.col("hole"), 1)).alias("holes"),
    )
    return whole
