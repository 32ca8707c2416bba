"""Survey points from CSV files whose header names its coordinates in one of several ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names by preference, compared without case.
EASTINGS, NORTHINGS = ("lon", "longitude", "easting"), ("lat", "latitude", "northing")


def read_points(spark: SparkSession, path: str, x_col: str = "x", y_col: str = "y") -> DataFrame:
    """All columns of the file plus ``x`` and ``y`` as doubles; ValueError without coordinates."""
    table = spark.read.csv(path, header=True, inferSchema=True)
    names = {c.strip().lower(): c for c in table.columns}

    def find(first: str, others: tuple[str, ...]) -> str:
        for name in (first.lower(), *others):
            if name in names:
                return names[name]
        raise ValueError(f"none of {(first, *others)} in {table.columns}")

    x, y = find(x_col, EASTINGS), find(y_col, NORTHINGS)
    return table.withColumn("x", F.col(f"`{x}`").cast("double")).withColumn("y", F.col(f"`{y}`").cast("double"))
