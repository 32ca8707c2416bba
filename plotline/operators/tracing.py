"""Lines from skeleton pixels: chains of pixels with two neighbours, between ends and junctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators.checkpoints import written
from plotline.operators.raster import around, pixel_to_world
from plotline.operators.ranking import ranked
from plotline.operators.vectorise import ROW

#: Directions by number, clockwise from north, as (row, column) steps; the opposite of d is (d + 4) % 8.
STEPS = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def pixel_links(pixels: DataFrame) -> DataFrame:
    """``row, col, ways``: the directions in which each set pixel is linked with another one.

    Pixels that touch at a corner are linked unless a third pixel links them by edges, so that a corner of a
    line is no junction.
    """
    seen = around(pixels)
    flag = lambda d: F.col(f"p{d % 8 + 2}") == 1
    linked = [flag(d) if d % 2 == 0 else flag(d) & ~flag(d - 1) & ~flag(d + 1) for d in range(8)]
    return seen.select("row", "col", F.array_compact(F.array(*[F.when(k, F.lit(d)) for d, k in enumerate(linked)])).alias("ways"))


def traced(pixels: DataFrame) -> DataFrame:
    """``line, seq, row, col``: set pixels ``row, col`` as lines, each in the order of its pixels from 0.

    A line runs between two pixels that have not two links, or around a loop; its end pixels belong to every
    line that meets there. Of its two directions the one counts that begins with the smaller pixel; a loop
    begins and ends at its smallest one. Single pixels make no line. Rows are below 2^28.
    """
    nodes = written(pixel_links(pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()))
    move = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in STEPS]), F.col("way") + 1)
    number = lambda r, c, d: (r * F.lit(ROW) + c) * 8 + d
    out = nodes.select("row", "col", F.explode("ways").alias("way"))
    links = out.withColumn("r", F.col("row") + move(0)).withColumn("c", F.col("col") + move(1)).withColumn("back", (F.col("way") + 4) % 8)
    named = links.withColumn("link", number(F.col("row"), F.col("col"), F.col("way"))).withColumn("twin", number(F.col("r"), F.col("c"), F.col("back")))
    ahead = nodes.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("ways").alias("then"))
    onward = F.get(F.filter("then", lambda d: d != F.col("back")), F.lit(0))
    known = written(named.join(ahead, ["r", "c"]).withColumn("next", F.when(F.size("then") == 2, number(F.col("r"), F.col("c"), onward))))
    placed = written(known.select("link", "twin", "row", "col", "r", "c").join(ranked(known.select("link", "next")), "link"))
    first = F.when(F.first("ring"), F.min("link")).otherwise(F.min_by("link", "seq"))
    other = F.when(F.first("ring"), F.min("twin")).otherwise(F.max_by("twin", "seq"))
    kept = placed.groupBy("chain").agg(first.alias("line"), other.alias("other"), F.max("seq").alias("most")).where("line < other")
    lines = placed.join(kept, "chain")
    starts = lines.select("line", "seq", "row", "col")
    return starts.unionByName(lines.where("seq = most").select("line", (F.col("seq") + 1).alias("seq"), F.col("r").alias("row"), F.col("c").alias("col")))


def center_lines(pixels: DataFrame, distance: str, least: float = 3.0, gsd: float = 1.0, x0: float = 0.0, y0: float = 0.0, thinnest: float = 1.5) -> DataFrame:
    """``line, points, length, width``: traced lines of at least a length, on the map.

    ``pixels`` hold the skeleton and each pixel's distance to the edge of the road, in pixels; the width is twice
    its mean along the line, at least ``thinnest``. The row of a line holds all its points.
    """
    x, y = pixel_to_world(F.col("row"), F.col("col"), x0, y0, gsd)
    wide: Column = F.col(distance).cast("double") * 2 * gsd
    known = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), wide.alias("w"))
    placed = traced(pixels).join(known, ["row", "col"]).select("line", F.struct("seq", x.alias("x"), y.alias("y")).alias("p"), "w")
    lines = placed.groupBy("line").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.greatest(F.avg("w"), F.lit(thinnest)).alias("width"))
    points = F.transform("ps", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    steps = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    measured = lines.withColumn("points", points).withColumn("length", F.aggregate(steps, F.lit(0.0), lambda s, d: s + d))
    return measured.where(F.col("length") >= least).select("line", "points", "length", "width")
