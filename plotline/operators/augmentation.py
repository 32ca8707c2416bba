"""Seeded augmentation of training chips: every pixel of a chip moves by the same draws.

Chips are pixel relations ``chip, row, col`` with columns for channels and masks, square, numbered from 0. A draw is a
hash of seed, epoch, chip and name, so that a chip's augmentation is the same in whatever task and order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chances of the flips, turns, contrast and blur, and the largest change of brightness and contrast.
FLIP, TURN, JITTER, BLUR, LIMIT = 0.5, 0.5, 0.5, 0.3, 0.15


def draw(seed: int, name: str, chip: str = "chip") -> Column:
    """A number in [0, 1) from a hash of seed, chip and name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col(chip).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def moved(chips: DataFrame, size: int, seed: int) -> DataFrame:
    """Chips flipped and turned by quarters, all columns together: only ``row`` and ``col`` change."""
    last = size - 1
    flip = lambda c, name: F.when(draw(seed, name) < FLIP, last - F.col(c)).otherwise(F.col(c))
    quarters = F.when(draw(seed, "turn") < TURN, F.floor(4 * draw(seed, "quarters"))).otherwise(0)
    flipped = chips.withColumns({"r_": flip("row", "upside"), "c_": flip("col", "sideways"), "q_": quarters})
    # A quarter turn to the left takes row r, column c to row last - c, column r.
    row = F.when(F.col("q_") == 0, F.col("r_")).when(F.col("q_") == 1, last - F.col("c_")).when(F.col("q_") == 2, last - F.col("r_")).otherwise(F.col("c_"))
    col = F.when(F.col("q_") == 0, F.col("c_")).when(F.col("q_") == 1, F.col("r_")).when(F.col("q_") == 2, last - F.col("c_")).otherwise(last - F.col("r_"))
    return flipped.withColumns({"row": row.cast("int"), "col": col.cast("int")}).drop("r_", "c_", "q_")


def jittered(chips: DataFrame, channels: list[str], seed: int) -> DataFrame:
    """Chips with changed brightness and contrast of the channels (0 to 1), the same for all of a chip."""
    change = lambda name: (2 * draw(seed, name) - 1) * LIMIT
    made = lambda c: F.least(F.greatest(F.col(c) * (1 + change("contrast")) + change("brightness"), F.lit(0.0)), F.lit(1.0))
    return chips.withColumns({c: F.when(draw(seed, "jitter") < JITTER, made(c)).otherwise(F.col(c)) for c in channels})


def _weights(reach: int) -> list[float]:
    """Of a Gaussian over 2 reach + 1 pixels, with the usual deviation for that width."""
    deviation = 0.3 * (reach - 1) + 0.8
    raw = [math.exp(-(k * k) / (2 * deviation * deviation)) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def blurred(chips: DataFrame, channels: list[str], size: int, seed: int) -> DataFrame:
    """Some chips blurred over 3 or 5 pixels in both directions, mirrored at the borders without their edge pixel.

    A line of a chip is a window; a chip must have at least three pixels a side.
    """
    reach = F.when(draw(seed, "blur") >= BLUR, 0).when(draw(seed, "width") < 0.5, 1).otherwise(2)
    found = chips.withColumn("reach_", reach)
    for axis, other in (("col", "row"), ("row", "col")):
        line = Window.partitionBy("chip", other).orderBy(axis)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = found.withColumns({f"{c}_": F.collect_list(c).over(whole) for c in channels})
        at = lambda k: F.when(F.col(axis) + k < 0, -(F.col(axis) + k)).when(F.col(axis) + k >= size, 2 * (size - 1) - F.col(axis) - k).otherwise(F.col(axis) + k)  # noqa: B023, E731
        mean = lambda c, n: sum((w * F.get(f"{c}_", at(k)) for k, w in zip(range(-n, n + 1), _weights(n), strict=True)), F.lit(0.0))  # noqa: B023, E731
        mixed = {c: F.when(F.col("reach_") == 0, F.col(c)).when(F.col("reach_") == 1, mean(c, 1)).otherwise(mean(c, 2)) for c in channels}
        found = held.withColumns(mixed).drop(*[f"{c}_" for c in channels])
    return found.drop("reach_")


def augmented(chips: DataFrame, channels: list[str], size: int, seed: int) -> DataFrame:
    """Jitter and blur of the channels alone, then flips and turns of channels and masks together.

    Chips must be whole: ``size`` rows and columns, no nulls in the channels. No chips give none.
    """
    return moved(blurred(jittered(chips, channels, seed), channels, size, seed), size, seed)


def rethresholded(chips: DataFrame, masks: list[str], distance: str | None = None, classes: str | None = None) -> DataFrame:
    """Masks as 0 and 1 again, distances within 0 and 1 and classes as whole numbers, after a resampling has blended them."""
    found = chips.withColumns({m: (F.col(m) > 0.5).cast("double") for m in masks})
    if distance is not None:
        found = found.withColumn(distance, F.least(F.greatest(F.col(distance), F.lit(0.0)), F.lit(1.0)))
    return found if classes is None else found.withColumn(classes, F.rint(classes).cast("long"))
