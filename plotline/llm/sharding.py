"""Sharding by balanced label propagation.

Documents of equal text are linked. Every linked document carries a shard as its label and, in each
round, moves towards the shards that most of its neighbours are in, as far as these have room. Room is
a quota of rows, so that the shards' sizes stay even; a group larger than a quota is laid over few
shards, where single rows that find these full stay elsewhere. What remains after the rounds, and all
unlinked documents, fill the quotas exactly.

Law ``rows``: the shards' row counts are at most one apart. Neighbours' labels are counted by group and
shard in Spark, so a group costs one row per shard however large it is; a row joins its group's counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.operators.checkpoints import checkpointed

ROUNDS = 4
#: Rows that are numbered in one window; more are numbered in blocks and joined by the blocks' offsets.
BLOCK_ROWS = 50_000


def _unit(*columns: str, salt: int) -> Column:
    """A uniform number in [0, 1) of the row's own values."""
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _numbered(df: DataFrame, by: list[str], rows: int, shards: int) -> DataFrame:
    """``df`` with ``number``, gapless from 0 within ``by``, from blocks of bounded size."""
    blocks = max(1, math.ceil(rows / (BLOCK_ROWS * (shards if by else 1))))
    dealt = df.withColumn("block", F.pmod(F.xxhash64("doc_id", "group", F.lit(7)), F.lit(blocks)))
    own = dealt.withColumn("within", F.row_number().over(Window.partitionBy(*by, "block").orderBy("doc_id", "group")) - 1)
    order = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "block").agg(F.count("*").alias("size_")).withColumn("start", F.coalesce(F.sum("size_").over(order), F.lit(0)))
    return own.join(starts.drop("size_"), [*by, "block"]).withColumn("number", F.col("within") + F.col("start")).drop("block", "within", "start")


def propagate(linked: DataFrame, quotas: DataFrame, shards: int, least: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (doc_id, group, label, ...) with labels moved towards the neighbours' shards.

    ``quotas`` (label, quota) has one row per shard and is broadcast for that; ``least`` is the smallest.
    """
    current = checkpointed(linked)
    for step in range(rounds):
        load = current.groupBy("label").agg(F.count("*").alias("load"))
        room = F.broadcast(quotas.join(F.broadcast(load), "label", "left").select("label", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room")))
        votes = current.groupBy("group", "label").agg(F.count("*").alias("votes"))
        everywhere = votes.groupBy("group").agg(F.sum("votes").alias("total"))
        # A group that no shard holds may also go where it has no row yet.
        large = everywhere.where(F.col("total") > least).select("group", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("label"))
        offers = votes.unionByName(large.withColumn("votes", F.lit(0).cast("long")))
        offers = offers.groupBy("group", "label").agg(F.sum("votes").alias("votes")).join(room, "label")
        offers = offers.withColumn("holds", F.col("votes") + F.greatest("room", F.lit(0)))
        order = Window.partitionBy("group").orderBy(F.desc("votes"), F.xxhash64("group", "label"))
        ranges = (
            offers.where("holds > 0").withColumn("upto", F.sum("holds").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("group").agg(F.sort_array(F.collect_list(F.struct("upto", "label"))).alias("ranges"))
        )
        at = _unit("doc_id", "group", salt=1) * F.col("total")
        target = F.get(F.filter("ranges", lambda r: r["upto"] > at), F.lit(0))["label"]
        wishes = current.join(everywhere, "group").join(ranges, "group", "left").withColumn("target", F.coalesce(target, F.col("label"))).drop("ranges", "total")
        wishes = checkpointed(wishes)
        asked = wishes.where("target <> label").groupBy(F.col("target").alias("label")).agg(F.count("*").alias("asked"))
        if not asked.head(1):
            break
        chance = room.join(F.broadcast(asked), "label").select(F.col("label").alias("target"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("room") / F.col("asked"))).alias("chance"))
        # The last round that finds a shard full leaves a row where it is.
        moved = (_unit("doc_id", "group", salt=100 + step) < F.col("chance")) & (F.col("target") != F.col("label"))
        current = checkpointed(
            wishes.join(F.broadcast(chance), "target", "left").withColumn("label", F.when(moved, F.col("target")).otherwise(F.col("label"))).drop("target", "chance")
        )
    return current


def assign_shards(df: DataFrame, id_col: str, text_col: str, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, copies``: one row per row of ``df``.

    ``size`` is the text's UTF-8 bytes plus 16, ``copies`` the rows of equal text. Shards hold at most
    one row more than others; slots run from 0 without gaps. A null text counts as an empty one; empty
    texts are equal texts and linked. A null id and rows that repeat an id are rows like others. With
    fewer rows than shards some shards are empty; an empty table gives an empty result. Other columns
    are ignored. ``grown_shard`` is null under this law.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = checkpointed(df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text.cast("binary"))).alias("group"),
    ))
    total = rows.count()
    quota = (F.floor(F.lit(total) / shards) + F.when(F.col("id") < total % shards, 1).otherwise(0)).cast("long")
    quotas = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("label"), quota.alias("quota"))
    copies = rows.groupBy("group").agg(F.count("*").alias("copies"))
    known = checkpointed(rows.join(copies, "group"))
    linked = known.where("copies > 1").withColumn("label", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int"))
    settled = propagate(linked, quotas, shards, total // shards, rounds)

    numbered = checkpointed(_numbered(settled, ["label"], total, shards).join(F.broadcast(quotas), "label"))
    kept = numbered.where("number < quota")
    over = numbered.where("number >= quota").drop("label", "number", "quota")
    free = checkpointed(_numbered(known.where("copies = 1").unionByName(over), [], total, shards))
    held = kept.groupBy("label").agg(F.count("*").alias("held"))
    # One row per shard: where the free rows that it takes begin and end among the free rows' numbers.
    taken = {r["label"]: r["held"] for r in held.collect()}
    gaps, start = [], 0
    for r in sorted(quotas.collect(), key=lambda r: r["label"]):
        have = taken.get(r["label"], 0)
        gaps.append(F.struct(F.lit(start + r["quota"] - have).cast("long").alias("upto"), F.lit(have - start).cast("long").alias("shift"), F.lit(r["label"]).alias("label")))
        start += r["quota"] - have
    gap = F.get(F.filter(F.array(*gaps), lambda g: g["upto"] > F.col("number")), F.lit(0))
    filled = free.withColumn("gap", gap)
    columns = lambda shard, slot: [
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "copies",
    ]
    placed = filled.select(*columns(F.col("gap.label"), F.col("number") + F.col("gap.shift")))
    return kept.select(*columns(F.col("label"), F.col("number"))).unionByName(placed)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 39."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
