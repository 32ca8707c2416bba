"""Hard negatives of anchors by blocked dense products.

Anchors are taken in waves of bounded bytes; each wave's matrix is broadcast, and every task multiplies
it with blocks of its own candidates, which stay where they are. The products are exact: in float64 while
they can't reach 2**53, else in 64-bit integers. A task keeps the best positives of every anchor over all
its blocks; the lists of the tasks are merged by a window. With the positives' scores known, a second pass
keeps for every anchor and positive the best candidates of other labels inside its window of scores.
A block's scores are compared with the last one kept so far, so that few of them are sorted.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm._vectors import integer_vectors, matrix
from plotline.operators.checkpoints import checkpointed, ensure_checkpoint_dir

#: Bytes of a wave's anchors, about.
WAVE_BYTES = 8 << 20
#: Scores of a block of candidates, and candidates in it at most.
BLOCK_SCORES, BLOCK_ROWS = 1 << 20, 2048
LOWEST = np.iinfo(np.int64).min
FOUND_SCHEMA = "slot long, row long, vec_id long, score long"


class Best:
    """The k best (score, id) of each slot, larger scores first, then smaller ids; mergeable."""

    def __init__(self, slots: int, k: int):
        self.k, self.cut = k, np.full(slots, LOWEST, np.int64)
        self.slot = self.score = self.vec_id = self.row = np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        vec_id, row = np.concatenate([self.vec_id, vec_id]), np.concatenate([self.row, row])
        order = np.lexsort((row, vec_id, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        kept = order[rank < self.k]
        self.slot, self.score, self.vec_id, self.row = slot[rank < self.k], score[kept], vec_id[kept], row[kept]
        self.cut[slot[rank == self.k - 1]] = score[order[rank == self.k - 1]]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"slot": self.slot, "row": self.row, "vec_id": self.vec_id, "score": self.score})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exactly."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    kind = np.float64 if largest < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def _blocks(batches: Iterator[pd.DataFrame], anchors: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    rows = max(1, min(BLOCK_ROWS, BLOCK_SCORES // max(1, len(anchors))))
    for batch in batches:
        for at in range(0, len(batch), rows):
            block = batch.iloc[at : at + rows]
            yield block, products(anchors, matrix(block["weights"]))


def _best_of_wave(table: DataFrame, wave: dict, windows: np.ndarray | None, k: int) -> DataFrame:
    """Each task's k best per slot: positives of every anchor, or negatives of every anchor and positive.

    ``windows`` holds anchor, lowest and highest score of each slot of negatives; slots are its rows.
    """
    shared = table.sparkSession.sparkContext.broadcast((wave, windows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wave, windows = shared.value
        best = Best(len(wave["row"]) if windows is None else len(windows), k)
        if windows is not None:
            # Slots of the first, second, ... positive of each anchor: one row of scores each.
            order = np.argsort(windows[:, 0], kind="stable")
            nth = np.arange(len(order)) - np.searchsorted(windows[order, 0], windows[order, 0])
            layers = [order[nth == n] for n in range(int(nth.max(initial=-1)) + 1)]
        for block, scores in _blocks(batches, wave["weights"]):
            ids, rows, labels = (block[c].to_numpy(np.int64) for c in ("vec_id", "row", "label"))
            same = wave["label"][:, None] == labels
            if windows is None:
                near = same & (scores >= best.cut.astype(scores.dtype)[:, None]) & (wave["row"][:, None] != rows)
                slot, at = np.nonzero(near)
                best.add(slot, scores[slot, at].astype(np.int64), ids[at], rows[at])
                continue
            for layer in layers:
                anchor = windows[layer, 0]
                own = scores[anchor]
                least = np.maximum(windows[layer, 1], best.cut[layer]).astype(scores.dtype)
                i, at = np.nonzero((own >= least[:, None]) & (own <= windows[layer, 2].astype(scores.dtype)[:, None]) & ~same[anchor])
                best.add(layer[i], own[i, at].astype(np.int64), ids[at], rows[at])
        yield best.frame()

    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id", "row")
    return table.mapInPandas(run, FOUND_SCHEMA).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256, wave_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` an integer expression over ``df``. The score of a
    row is its integer inner product with the anchor. Positives are an anchor's first other rows of its
    label, larger scores first, ties by the smaller id; for each of them the first ``negatives`` rows of
    other labels are returned whose score is ``low`` to ``high`` percent of the positive's, limits included:
    none for a positive of negative score. Every row is a row of its own: one that repeats an anchor is its
    positive, and repeated anchors give their rows again. Rows whose id, label or vector is null, or whose
    vector holds a null or non-finite component, take no part. Missing components of shorter vectors count as
    0. Anchors without positives or negatives, and empty tables, give no rows. Inner products must fit 64
    bits. Other columns are ignored. A wave is a pass over the written vectors; its result is written, too.
    """
    spark = df.sparkSession
    usable = integer_vectors(df, id_col, vector_col, scale, label=label.cast("long")).where("label is not null")
    table = checkpointed(usable.withColumn("row", F.monotonically_increasing_id()))
    sizes = table.agg(F.count(F.when(is_anchor, 1)).alias("n"), F.coalesce(F.max(F.size("weights")), F.lit(0)).alias("d")).first()
    # A hash deals anchors to waves evenly; twice the mean is never met.
    waves = max(1, math.ceil(2 * sizes["n"] * 8 * max(1, sizes["d"]) / wave_bytes)) if sizes["n"] else 0
    folder = f"{ensure_checkpoint_dir(spark)}/negatives-{uuid.uuid4()}"
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kinds).write.parquet(f"{folder}/wave=-1")
    for w in range(waves):
        drawn = table.where(is_anchor & (F.pmod(F.xxhash64("row"), F.lit(waves)) == w)).orderBy("row").toPandas()
        wave = {c: drawn[c].to_numpy(np.int64) for c in ("row", "vec_id", "label")} | {"weights": matrix(drawn["weights"], sizes["d"])}
        near = _best_of_wave(table, wave, None, positives).orderBy("slot", "rank").toPandas()
        lows = [-(-low * s // 100) for s in near["score"].tolist()]
        highs = [high * s // 100 for s in near["score"].tolist()]
        windows = np.stack([near["slot"].to_numpy(np.int64), np.array(lows, np.int64), np.array(highs, np.int64)], axis=1)
        known = spark.createDataFrame(
            pd.DataFrame({"slot": np.arange(len(near)), "anchor_id": wave["vec_id"][windows[:, 0]], "positive_id": near["vec_id"], "positive_score": near["score"]}),
            "slot long, anchor_id long, positive_id long, positive_score long",
        )
        found = _best_of_wave(table, wave, windows, negatives).join(F.broadcast(known), "slot")
        found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{folder}/wave={w}")
    return spark.read.schema(kinds).parquet(folder).select(*[c.split()[0] for c in kinds.split(", ")])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of five positives of every ``embeddings`` row whose vec_id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS a, a.vec_id AS anchor_id, b.row AS b, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
