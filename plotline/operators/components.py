"""Connected components of an undirected edge list by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.operators.checkpoints import checkpointed, release

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    smallest = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return (
        both.where("dst > src").join(smallest, "src")
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("dst < src")
    smallest = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(smallest, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    own = smallest.select("src", F.col("low").alias("dst"))
    return moved.unionByName(own).where("dst < src").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Return ``node, component`` for every node of ``edges``; the component is its smallest node.

    Nodes are longs. Self-loops, repeated and null edges are ignored; a node that has no other
    edge is absent, and callers coalesce it to itself. An empty edge list gives an empty result.
    Large-star and small-star alternate until nothing moves, which takes a logarithmic number of
    rounds also on long chains. A round's edges are written to the shared checkpoint folder by ``cut``; the
    driver only sees a count and a hash of them.
    """
    current = cut(
        edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    before = _fingerprint(current)
    if before[0]:
        for _ in range(MAX_ROUNDS):
            last, current = current, cut(_small_star(_large_star(current)))
            release(last)
            after = _fingerprint(current)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = current.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return leaves.unionByName(roots)
