"""Accuracy: parcel matching, mask and boundary metrics, losses, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.functions.geometry import box_area, iou, shared_area
from plotline.operators.raster import dilate
from plotline.operators.spatial_join import meeting_pairs

EPS = 1e-6


def best_matches(predicted: DataFrame, reference: DataFrame, cell: float = 25.0, least: float = 0.5) -> DataFrame:
    """Each predicted parcel with the reference parcel of highest IoU, ties to the smaller id, if at least ``least``."""
    pairs = meeting_pairs(predicted, reference, cell).where(shared_area("a_", "b_") > 0).withColumn("iou", iou("a_", "b_"))
    error = F.abs(box_area("a_") - box_area("b_")) / F.greatest(box_area("b_"), F.lit(1.0))
    best = pairs.withColumn("error", error).groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct((-F.col("iou")).alias("n"), F.col("b_id").alias("ref"), "error")).alias("m"))
    return best.select("id", F.col("m.ref").alias("ref_id"), (-F.col("m.n")).alias("iou"), F.col("m.error").alias("area_error")).where(F.col("iou") >= least)


def parcel_accuracy(predicted: DataFrame, reference: DataFrame, cell: float = 25.0) -> DataFrame:
    """One row; where nothing matches the mean IoU and the mean error are null, not a default."""
    found = best_matches(predicted, reference, cell)
    one = lambda df: df.withColumn("one", F.lit(1))
    a = found.agg(F.avg("iou").alias("mean_iou"), F.countDistinct("ref_id").alias("refs"), F.count("*").alias("matched"), (F.avg("area_error") * 100).alias("mean_area_error_pct"))
    n, m = predicted.agg(F.count("*").alias("n_pred")), reference.agg(F.count("*").alias("n_ref"))
    return one(a).join(one(n), "one").join(one(m), "one").select(
        F.col("n_pred").alias("parcels_count"), "mean_iou", (F.col("refs") / F.col("n_ref")).alias("completeness"), (F.col("matched") / F.col("n_pred")).alias("correctness"), "mean_area_error_pct"
    )


def confusion(predicted: Column, truth: Column) -> list[Column]:
    """Precision, recall, F1 and IoU of two masks, as aggregates."""
    count = lambda c: F.sum(c.cast("double"))
    tp, fp, fn = count(predicted & truth), count(predicted & ~truth), count(~predicted & truth)
    precision, recall = (tp + EPS) / (tp + fp + EPS), (tp + EPS) / (tp + fn + EPS)
    return [
        precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + EPS)).alias("f1"),
        ((tp + EPS) / (tp + fp + fn + EPS)).alias("iou"),
    ]


def boundary_f1(masks: DataFrame, tolerance: int = 3) -> DataFrame:
    """F1 of boundary pixels ``p`` and ``t`` within a tolerance: 1 if both are empty, 0 if one is."""
    wide = dilate(dilate(masks.withColumn("p_", F.col("p").cast("int")).withColumn("t_", F.col("t").cast("int")), "p_", tolerance), "t_", tolerance)
    s = wide.agg(
        F.sum(F.col("p").cast("int")).alias("np"), F.sum(F.col("t").cast("int")).alias("nt"),
        F.sum((F.col("p") & (F.col("t_") == 1)).cast("int")).alias("hp"), F.sum((F.col("t") & (F.col("p_") == 1)).cast("int")).alias("ht"),
    )
    precision, recall = (F.col("hp") + EPS) / (F.col("np") + EPS), (F.col("ht") + EPS) / (F.col("nt") + EPS)
    f1 = F.when((F.col("np") == 0) & (F.col("nt") == 0), 1.0).when((F.col("np") == 0) | (F.col("nt") == 0), 0.0).otherwise(2 * precision * recall / (precision + recall + EPS))
    return s.select(f1.alias("boundary_f1"))


def dice_loss(p: Column, t: Column, smooth: float = 1.0) -> Column:
    return 1 - (2 * F.sum(p * t) + smooth) / (F.sum(p) + F.sum(t) + smooth)


def tversky_loss(p: Column, t: Column, alpha: float = 0.3, beta: float = 0.7, smooth: float = 1.0) -> Column:
    tp, fp, fn = F.sum(p * t), F.sum(p * (1 - t)), F.sum((1 - p) * t)
    return 1 - (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)


def bce_loss(logit: Column, t: Column, positive_weight: float = 1.0) -> Column:
    """Mean binary cross-entropy of logits, stable for large ones."""
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    return F.avg((1 - t) * logit + (1 + (positive_weight - 1) * t) * soft)


def l1_loss(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def cross_entropy(logits: Column, label: Column, ignore: int = -1) -> Column:
    """Mean cross-entropy of an array of logits, without ignored labels."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.avg(F.when(label != ignore, F.log(total) + top - F.get(logits, label)))


def cosine_rate(epoch: Column, epochs: int, start: float, floor: float) -> Column:
    """Learning rate at an epoch, falling along half a cosine."""
    return floor + (start - floor) * (1 + F.cos(math.pi * epoch / epochs)) / 2


def cosine_schedule(spark: SparkSession, epochs: int, start: float, floor: float) -> DataFrame:
    """Learning rate by epoch."""
    return spark.range(epochs).select(F.col("id").alias("epoch"), cosine_rate(F.col("id"), epochs, start, floor).alias("lr"))


def best_epoch(history: DataFrame, score: str = "f1", epoch: str = "epoch") -> DataFrame:
    """The epoch of the highest score, the first of equals."""
    return history.agg(F.min_by(F.struct(epoch, score), F.struct(-F.col(score), F.col(epoch))).alias("b")).select(f"b.{epoch}", f"b.{score}")


def flipped_mean(p: DataFrame, width: int, height: int, horizontal: DataFrame, vertical: DataFrame) -> DataFrame:
    """Mean of a prediction and of those of the mirrored images, mirrored back."""
    back = horizontal.withColumn("col", (F.lit(width - 1) - F.col("col")).cast("int")).unionByName(vertical.withColumn("row", (F.lit(height - 1) - F.col("row")).cast("int")))
    return p.unionByName(back).groupBy("row", "col").agg(F.avg("v").alias("v"))


def effort(parcels: Column, manual_hours: float = 0.25, assisted_hours: float = 0.025) -> list[Column]:
    """Hours saved, and the ratio of the assumed efforts."""
    return [(parcels * (manual_hours - assisted_hours)).alias("manual_hours_saved"), F.lit(manual_hours / assisted_hours).alias("efficiency_gain_factor")]


def epoch_means(images: DataFrame, epoch: str, batch: str, loss: str, scores: list[str]) -> DataFrame:
    """Per epoch the mean of the batches' losses, each batch counting once, and the mean of the images' scores.

    ``images`` holds a row per image; a batch's loss is the mean over its images. Null scores count nowhere.
    """
    batches = images.groupBy(epoch, batch).agg(F.avg(loss).alias("loss_"), *[F.sum(s).alias(f"{s}_sum") for s in scores], *[F.count(s).alias(f"{s}_n") for s in scores])
    return batches.groupBy(epoch).agg(F.avg("loss_").alias(loss), *[F.try_divide(F.sum(f"{s}_sum"), F.sum(f"{s}_n")).alias(s) for s in scores])
