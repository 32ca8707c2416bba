"""Cutting lineage so that a lost executor costs a re-read, not a recomputation."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names a folder that all executors share. Only where it is unset and driver
    and executors are one machine (``local`` masters, as in tests) a temporary folder is made; on a
    cluster it must be set.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now and read it from there afterwards.

    Once it is written the shuffle files behind it are of no more use; Spark is told to remove them then,
    instead of whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # Another frame, as the setting holds for those made under it.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are spelled out to many next, dealt to as many tasks as a shuffle has, by ``keys`` if there are any.

    The number is given, since a small shuffle's partitions would be merged again, whatever comes of its rows.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def in_few_files(df: DataFrame) -> DataFrame:
    """Rows of a small table in about an eighth of a shuffle's partitions, or four a core where that is more.

    To be written next: a file on a local file system takes Spark a process for its rights, and each of these looks
    as large as the executor until it begins its own program. A task reads its partitions one after the other.
    """
    spark = df.sparkSession
    return df.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 8, 4 * spark.sparkContext.defaultParallelism))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it; the table ``instead_of`` goes then.

    For rounds of joins: a table's size is known from its files, while a checkpoint keeps the estimate of the plan
    that made it, which multiplies from join to join and from round to round. ``instead_of`` must come from
    this function, and nothing may read it any more.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    found = spark.read.schema(df.schema).parquet(folder)
    found._table_folder = folder
    if instead_of is not None:
        release(instead_of)
    return found


def release(df: DataFrame) -> None:
    """Delete the table of a frame that ``written`` returned, once nothing reads it; other frames stay as they are."""
    if folder := getattr(df, "_table_folder", None):
        remove_folder(df.sparkSession, folder)
