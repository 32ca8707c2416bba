"""Order along chains and rings of links, by pointer doubling.

Each link knows the next one. A round lets every link look twice as far, so that the rounds grow with the
logarithm of the longest chain; a round is one join of the links with themselves, whatever the chains are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators.checkpoints import written


def _doubled(state: DataFrame) -> DataFrame:
    """Every link's view joined with that of the link it sees last.

    A ring's smallest link that is seen in both views tells how many links the ring has, the first time it is.
    """
    ahead = state.select(F.col("link").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("low_"), F.col("at").alias("at_"), F.col("last").alias("last_"), F.col("steps").alias("steps_"))
    seen = state.where("ptr is not null").join(ahead, "ptr")
    lower = F.col("low_") < F.col("low")
    met = F.when(F.col("low_") == F.col("low"), F.col("steps") + F.col("at_") - F.col("at"))
    moved = seen.select(
        "link", F.col("far").alias("ptr"), F.least("low", "low_").alias("low"), F.when(lower, F.col("steps") + F.col("at_")).otherwise(F.col("at")).alias("at"),
        F.col("last_").alias("last"), (F.col("steps") + F.col("steps_")).alias("steps"), F.coalesce("n", met).alias("n"),
    )
    return moved.unionByName(state.where("ptr is null"))


def ranked(links: DataFrame) -> DataFrame:
    """``link, chain, seq, ring`` of ``link, next`` (longs): the place of every link in its chain, from 0.

    ``next`` is null at a chain's end, and no two links have the same next one. ``chain`` is the last link
    of an open chain, or the smallest link of a ring, which is its first. A ``next`` that is no link of the
    table is not allowed. No links give no rows. Each link carries how far it sees, the last link that it
    sees, and the smallest one with its distance; a chain's end or a ring's smallest link is the fixed point
    from which places are counted. A ring takes part until its links see all of it, so that short ones leave early.
    """
    known = links.select(F.col("link").cast("long").alias("link"), F.col("next").cast("long").alias("ptr"))
    state = written(known.select(
        "link", "ptr", F.col("link").alias("low"), F.lit(0).cast("long").alias("at"), F.coalesce("ptr", "link").alias("last"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.lit(None).cast("long").alias("n"),
    ))
    # Half of what a link sees now is a view of before: where that had the whole ring, all of its links know its length.
    whole = F.coalesce(F.col("ptr").isNotNull() & (2 * F.col("n") <= F.col("steps")), F.lit(False))
    rings: list[DataFrame] = []
    going = state.where("ptr is not null").head(1)
    live = state
    while going:
        state = written(_doubled(live), state)
        left, over = state.agg(F.count(F.when(F.col("ptr").isNotNull() & ~whole, 1)), F.count(F.when(whole, 1))).first()
        if over:
            rings.append(written(state.where(whole).select("link", F.col("low").alias("chain"), F.pmod(F.col("n") - F.col("at"), F.col("n")).alias("seq"), F.lit(True).alias("ring"))))
        live, going = state.where(~whole), left
    placed = live.select("link", F.col("last").alias("chain"), "steps")
    # Counts are combined before they travel, and Spark can split a join of a long chain.
    lengths = placed.groupBy("chain").agg(F.max("steps").alias("most"))
    found = placed.join(lengths, "chain").select("link", "chain", (F.col("most") - F.col("steps")).alias("seq"), F.lit(False).alias("ring"))
    for ring in rings:
        found = found.unionByName(ring)
    return found
