"""Ground truth: matching survey points to parcels, offsets, verdicts; and parcel edits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.geometry import box_boundary_distance
from plotline.operators.spatial_join import nearest_box


def matched_points(points: DataFrame, parcels: DataFrame, cell: float = 25.0) -> DataFrame:
    """Each point with its nearest parcel and its offset from that parcel's boundary."""
    near = nearest_box(points.select("seq", "x", "y"), parcels, "seq", "id", cell)
    return near.withColumn("offset", box_boundary_distance(F.col("x"), F.col("y"), "b_")).select("seq", F.col("id").alias("parcel"), "offset")


def folded_offsets(matches: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Per parcel the offset of its points in order of ``seq``, each halving what came before, and the last verdict.

    The fold has a closed form: the last point weighs 1/2, the one before 1/4, and the first as much as the
    second. Points are numbered by a window, which streams them, and a sum follows; no array of them is held.
    """
    latest = Window.partitionBy("parcel").orderBy(F.desc("seq"))
    back = F.row_number().over(latest)
    placed = matches.select("parcel", "seq", "offset", back.alias("back"), F.lead("seq").over(latest).isNull().alias("first"))
    weight = F.pow(F.lit(0.5), F.col("back") - F.col("first").cast("int"))
    found = placed.groupBy("parcel").agg(
        F.count("*").alias("n_points"), F.sum(weight * F.col("offset")).alias("gt_offset_m"), F.max(F.when(F.col("back") == 1, F.col("offset"))).alias("last")
    )
    return found.select("parcel", "n_points", "gt_offset_m", F.when(F.col("last") <= tolerance, "verified").otherwise("disputed").alias("status"))


def offset_metrics(matches: DataFrame, folded: DataFrame) -> DataFrame:
    """One row: points, mean offset, verified parcels."""
    one = lambda df: df.withColumn("one", F.lit(1))
    a = matches.agg(F.count("*").alias("total_gt_points"), F.round(F.avg("offset"), 3).alias("mean_boundary_offset_m"))
    b = folded.agg(F.count(F.when(F.col("status") == "verified", 1)).alias("verified_parcels_count"))
    return one(a).join(one(b), "one").drop("one")


def folded_edits(edits: DataFrame, parcel: str, seq: str, version: str) -> DataFrame:
    """Optimistic locking: an edit is accepted if it names the current version, which begins at 1.

    Per parcel the edits in order of ``seq`` fold to the accepted count and the final version. A parcel's
    edits meet in one task, sorted by Spark; the task streams them and holds a version and a count.
    """
    ordered = edits.select(F.col(parcel).cast("long").alias(parcel), F.col(seq).alias("seq"), F.col(version).cast("long").alias("version"))
    ordered = ordered.repartition(parcel).sortWithinPartitions(parcel, "seq")
    schema = f"{parcel} long, n_edits long, version long, accepted long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            done = []
            for key, named in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or key != state[0]:
                    done += [state] if state else []
                    state = [key, 0, 1]
                state[1] += 1
                state[2] += named == state[2]
            if done:
                yield table(done)
        if state:
            yield table([state])

    def table(rows: list[list]) -> pa.RecordBatch:
        keys, counts, versions = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
        return pa.record_batch([keys, counts, versions, pc.subtract(versions, 1)], names=[parcel, "n_edits", "version", "accepted"])

    return ordered.mapInArrow(run, schema)


def scrubbed(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls, for JSON and exports."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*[F.when(~bad(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
