"""Spatial joins: candidate pairs by grid cells and equality, then the exact predicate.

A range predicate alone makes a nested-loop join. Each box is copied to the grid cells that it covers and
the join is on the cell, which hashes and shuffles; a pair that meets in several cells is kept in the one
that holds the lower left corner of the boxes' intersection, so no distinct is needed. Cells should be
about as large as typical boxes; much larger boxes go on coarser grids, where the others look for them,
so that a box has a few dozen copies at most. Spark splits a crowded cell's rows by its skew-join rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.geometry import BOX, box_distance, boxes_meet
from plotline.operators.checkpoints import checkpointed, dealt


#: Each grid's cells are STEP times as wide as the next finer one's; a box covers SPAN cells of its own grid per axis, and one more.
STEP, SPAN = 8, 4
#: Boxes of a cell that a point looks at in one row; points of a place in one row.
CROWD = 64
#: Pairs of points of the same cell for which a task is made.
NEAR = 2**23


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose coordinates are all numbers, and not infinite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf")))
    return df


def _level(prefix: str, cell: float) -> Column:
    """The grid of a box: 0, or the first on which it covers few cells."""
    extent = F.greatest(F.col(f"{prefix}x1") - F.col(f"{prefix}x0"), F.col(f"{prefix}y1") - F.col(f"{prefix}y0"), F.lit(1e-300))
    return F.greatest(F.ceil(F.log(extent / (SPAN * cell)) / math.log(STEP)), F.lit(0)).cast("int")


def _celled(df: DataFrame, prefix: str, cell: float, levels: list[int]) -> DataFrame:
    """A copy of each box for the cells that it covers on its own grid and on each coarser one of ``levels``."""
    own = df.withColumn(f"{prefix}level", _level(prefix, cell))
    placed = own.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(f"{prefix}level"))))
    width = cell * F.pow(F.lit(float(STEP)), F.col("level"))
    span = lambda low, high: F.sequence(F.floor(F.col(prefix + low) / width), F.floor(F.col(prefix + high) / width))
    return placed.withColumn("cell_x", F.explode(span("x0", "x1"))).withColumn("cell_y", F.explode(span("y0", "y1")))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _one_grid(left: DataFrame, right: DataFrame, cell: float, condition: Column | None) -> DataFrame:
    """Pairs of boxes that all go on the finest grid."""
    at = lambda c: F.floor(c / cell)
    span = lambda df, p, c: df.withColumn(f"cell_{c}", F.explode(F.sequence(at(F.col(f"{p}{c}0")), at(F.col(f"{p}{c}1")))))
    a, b = (span(span(df, p, "x"), p, "y") for df, p in ((left, "a_"), (right, "b_")))
    corner = lambda c: at(F.greatest(F.col(f"a_{c}0"), F.col(f"b_{c}0")))
    meet = boxes_meet("a_", "b_") & (F.col("cell_x") == corner("x")) & (F.col("cell_y") == corner("y"))
    # Copies for cells are many more than Spark's estimate knows of: broadcast, they would be joined by the few tasks that read a small file.
    return a.join(b.hint("merge"), ["cell_x", "cell_y"]).where(meet if condition is None else meet & condition).drop("cell_x", "cell_y")


def meeting_pairs(left: DataFrame, right: DataFrame, cell: float, condition: Column | None = None) -> DataFrame:
    """Pairs of boxes that share a point, columns prefixed ``a_`` and ``b_``.

    Rows with a coordinate that is null, infinite or no number meet nothing. ``condition`` may name columns
    of both sides, such as ``a_id < b_id`` for a self-join.
    """
    same = left is right
    left, right = (finite(prefixed(df, p), [p + c for c in BOX]).where(f"{p}x0 <= {p}x1 and {p}y0 <= {p}y1") for df, p in ((left, "a_"), (right, "b_")))
    # One scan of each table tells which grids there are; a table joined with itself is scanned once.
    own = left.select(_level("a_", cell).alias("level"))
    levels = sorted(r[0] for r in (own if same else own.unionByName(right.select(_level("b_", cell).alias("level")))).distinct().collect()) or [0]
    if levels == [0]:
        return _one_grid(left, right, cell, condition)
    a, b = _celled(left, "a_", cell, levels), _celled(right, "b_", cell, levels)
    width = cell * F.pow(F.lit(float(STEP)), F.col("level"))
    corner = lambda c: F.floor(F.greatest(F.col(f"a_{c}"), F.col(f"b_{c}")) / width)
    # A pair meets on the grid of its larger box: either is on its own grid there, and two that both come from finer ones don't look at each other.
    a = a.withColumn("kind", (F.col("level") > F.col("a_level")).cast("int"))
    b = b.withColumn("kind", F.explode(F.when(F.col("level") == F.col("b_level"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    meet = boxes_meet("a_", "b_") & (F.col("cell_x") == corner("x0")) & (F.col("cell_y") == corner("y0"))
    if condition is not None:
        meet = meet & condition
    return a.join(b.hint("merge"), ["kind", "level", "cell_x", "cell_y"]).where(meet).drop("kind", "level", "a_level", "b_level", "cell_x", "cell_y")


def point_pairs_within(df: DataFrame, id_col: str, distance: float, condition: Column | None = None, digits: int | None = None) -> DataFrame:
    """Pairs of points (``x``, ``y``) at most ``distance`` apart, each once, ``a_`` id below ``b_`` id.

    Places meet in cells as wide as ``distance``; each looks in its own cell and in four of those around it, from
    where the other four look back. The points of a place are CROWD to a row: their distance to those of another place
    is found once and rounded to ``digits`` before their pairs are spelled out; ``condition`` sees it as it is. So no pair
    is shuffled, and pairs come in runs of one distance, in which ids repeat and files stay small. A cell is one task's.
    Points with a coordinate that is null, infinite or no number take no part.
    """
    others = [c for c in df.columns if c not in ("x", "y", id_col)]
    at = lambda c: F.floor(F.col(c) / distance).alias(f"cell_{c}")
    cell = ["cell_x", "cell_y"]
    rows = finite(df, ["x", "y"]).select("*", at("x"), at("y"))
    # A small table may make many pairs: tasks are as many as these ask for.
    near = rows.groupBy(*cell).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(near / NEAR))
    # Shuffled once, by cell: so are the points of a place and the places of a cell together.
    crowd = F.floor((F.row_number().over(Window.partitionBy(*cell, "x", "y").orderBy(id_col)) - 1) / CROWD)
    places = rows.repartition(tasks, *cell).withColumn("crowd", crowd).groupBy(*cell, "x", "y", "crowd")
    places = places.agg(F.array_sort(F.collect_list(F.struct(id_col, *others))).alias("ends"))
    key = ("x", "y", "crowd")
    whole = places.select(*cell, *[F.col(c).alias(f"p_{c}") for c in key], F.col("ends").alias("ps"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    seen = places.select(*[F.col(c).alias(f"q_{c}") for c in key], F.col("ends").alias("qs"), *cell, F.explode(steps).alias("s"))
    seen = seen.withColumn("cell_x", F.col("cell_x") + F.col("s.i")).withColumn("cell_y", F.col("cell_y") + F.col("s.j")).withColumn("own", (F.col("s.i") == 0) & (F.col("s.j") == 0)).drop("s")
    p, q = (F.struct(*[F.col(f"{k}_{c}").alias(c) for c in key]) for k in "pq")
    dx, dy = F.col("p_x") - F.col("q_x"), F.col("p_y") - F.col("q_y")
    apart = F.sqrt(dx * dx + dy * dy)
    met = whole.join(seen.repartition(tasks, *cell).hint("merge"), cell).where((apart <= distance) & (~F.col("own") | (p <= q)))
    met = met.select("p_x", "p_y", "ps", "q_x", "q_y", "qs", (F.col("own") & (p == q)).alias("same"), apart.alias("distance"), (apart if digits is None else F.round(apart, digits)).alias("shown"))
    # Left as they are, the partitions still part the join from what follows: in one step, a row's pairs with all that it meets would be held at once.
    spelled = met.coalesce(2**31 - 1).withColumn("p1", F.explode("ps")).withColumn("q1", F.explode("qs"))
    # Ids that are equal or null have no order.
    first = F.col(f"p1.{id_col}") < F.col(f"q1.{id_col}")
    pairs = spelled.where(first | (~F.col("same") & (F.col(f"p1.{id_col}") > F.col(f"q1.{id_col}"))))
    of = lambda c, k: F.col(f"{k}_{c}" if c in ("x", "y") else f"{k}1.{c}")
    side = lambda c, low, high, name: F.when(first, of(c, low)).otherwise(of(c, high)).alias(f"{name}_{c}")
    found = pairs.select(*[side(c, "p", "q", "a") for c in df.columns], *[side(c, "q", "p", "b") for c in df.columns], "distance", "shown")
    found = found if condition is None else found.where(condition)
    return found.drop("distance").withColumnRenamed("shown", "distance")


def nearest_box(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, cell: float) -> DataFrame:
    """The nearest box of every point: columns of ``points``, ``box_id``, ``distance`` (0 inside), ``b_x0`` ...

    Ties go to the smallest box id. Points look for boxes within a radius; those that find none look again
    four times as far on a coarser grid, until every point has its box. Points or boxes with a coordinate
    that is null, infinite or no number take no part; without boxes the result is empty. ``point_id`` must
    be unique.
    """
    b = checkpointed(prefixed(finite(boxes.select(F.col(box_id).alias("id"), *BOX), list(BOX)), "b_"))
    left = finite(points, ["x", "y"])
    if not b.head(1):
        left = left.limit(0)
    x, y = F.col("x"), F.col("y")
    done, radius = None, cell
    while True:
        levels = sorted(r[0] for r in b.select(_level("b_", radius)).distinct().collect())
        width = radius * F.pow(F.lit(float(STEP)), F.col("level"))
        cells = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))  # noqa: B023, E731
        # Boxes are copied to the cells from which points see them; a point is one row a grid, and looks at its cell's boxes there, CROWD of them at once.
        probe = dealt(left).withColumn("level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("cx", F.floor(x / width)).withColumn("cy", F.floor(y / width))
        copies = b.withColumn("level", _level("b_", radius)).withColumn("cx", cells(F.col("b_x0") - radius, F.col("b_x1") + radius)).withColumn("cy", cells(F.col("b_y0") - radius, F.col("b_y1") + radius))
        seen = copies.join(probe.select("level", "cx", "cy").distinct(), ["level", "cx", "cy"], "left_semi")
        crowd = F.floor(F.row_number().over(Window.partitionBy("level", "cx", "cy").orderBy("b_id")) / CROWD)
        grid = seen.withColumn("crowd", crowd).groupBy("level", "cx", "cy", "crowd").agg(F.collect_list(F.struct("b_id", *["b_" + c for c in BOX])).alias("boxes"))
        of = lambda k: F.struct(box_distance(x, y, "b_", k).alias("distance"), k["b_id"].alias("b_id"), *[k["b_" + c].alias("b_" + c) for c in BOX])
        least = F.array_min(F.filter(F.transform("boxes", of), lambda k: k["distance"] <= radius))
        near = probe.join(grid, ["level", "cx", "cy"]).withColumn("least", least).where("least is not null")
        found = F.min("least").alias("best")
        keep = [c for c in points.columns if c != point_id]
        best = checkpointed(
            near.groupBy(point_id).agg(*[F.first(c).alias(c) for c in keep], found)
            .select(*points.columns, F.col("best.b_id").alias(box_id), "best.distance", *["best.b_" + c for c in BOX])
        )
        done = best if done is None else done.unionByName(best)
        left = checkpointed(left.join(best.select(point_id), point_id, "left_anti"))
        if not left.head(1):
            return done
        radius *= 4
