"""Integer vectors of an embedding column, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, **others: Column) -> DataFrame:
    """``vec_id, weights`` and the named other columns: floor(scale * x) of every component as a long.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, are left out.
    """
    x = F.col("vector")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), *[c.alias(n) for n, c in others.items()])
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & sound)
        .select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("weights"), *others)
    )


def matrix(vectors: pd.Series, width: int = 0) -> np.ndarray:
    """The vectors as rows of int64, shorter ones filled up with zeros to ``width`` or the longest."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    width = max(width, int(lengths.max(initial=0)))
    if len(vectors) and (lengths == width).all():
        return np.stack(vectors.to_numpy()).astype(np.int64, copy=False).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out
