"""Admission rules over a raster catalogue, one row per raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def admitted(catalog: DataFrame, epsg: int = 32643, max_gsd: float = 0.2) -> DataFrame:
    """Errors and warnings of ``raster, type, epsg, bands, gsd``, each marked with the raster's type.

    No CRS and too few bands are errors; another CRS and coarse pixels of a projected raster are warnings.
    """
    tag = lambda text: F.concat(F.lit("["), F.col("type"), F.lit(f"] {text}"))
    few = (F.col("type") == "ORI") & (F.col("bands") < 3) | (F.col("bands") < 1)
    errors = F.array_compact(F.array(F.when(F.col("epsg").isNull(), tag("no CRS")), F.when(few, tag("fewer than 3 bands"))))
    coarse = (F.col("gsd") > max_gsd) & (F.coalesce("epsg", F.lit(4326)) != 4326)
    warnings = F.array_compact(F.array(F.when(F.col("epsg") != epsg, tag("not the project CRS")), F.when(coarse, tag("coarse pixels"))))
    return catalog.select("raster", "type", F.array_join(errors, "; ").alias("errors"), F.array_join(warnings, "; ").alias("warnings"), (F.size(errors) == 0).alias("is_valid"))


def rmse(accuracy_cm: str) -> Column:
    """Root mean square of accuracies given in centimetres, in metres."""
    return F.sqrt(F.avg(F.pow(F.col(accuracy_cm) / 100.0, F.lit(2.0))))


def misaligned(catalog: DataFrame, group: str, width: str, height: str, tolerance: float = 1e-6) -> DataFrame:
    """``group, error`` of the sets of rasters that don't fit together: ``raster, type, x0, y0, gsd`` and their sizes.

    The surface and terrain models of a set must have equal numbers of rows and columns; where they have, their
    upper left corners and pixels must be those of the image, within ``tolerance`` pixels. Sets without one of the
    three are not compared with it.
    """
    def of(kind: str) -> DataFrame:
        return catalog.where(F.col("type") == kind).select(group, *[F.col(c).alias(f"{kind}_{c}") for c in (width, height, "x0", "y0", "gsd")])

    found = of("DSM").join(of("DTM"), group, "full").join(of("ORI"), group, "left")
    unlike = (F.col(f"DSM_{width}") != F.col(f"DTM_{width}")) | (F.col(f"DSM_{height}") != F.col(f"DTM_{height}"))
    off = lambda c: F.abs(F.col(f"DSM_{c}") - F.col(f"ORI_{c}")) > tolerance * F.col("ORI_gsd")
    error = F.when(F.coalesce(unlike, F.lit(False)), "models of unlike shape").when(F.coalesce(off("x0") | off("y0") | off("gsd"), F.lit(False)), "models not on the image's grid")
    return found.select(group, error.alias("error")).where("error is not null")
