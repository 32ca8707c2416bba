"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are rows of an inverted index: term ``t`` has a posting (vector, weight) for every vector
whose component ``t`` is not zero. A sparse query walks its own terms; for each it scatters
query weight x posting weight into a dense array with one score per vector of the block. Partition
selection then keeps each block's k best, and the blocks' lists are merged.

Queries and vectors are cut into blocks of bounded size by a hash of the row, and each task scores
one block of queries against one block of vectors, so that nothing is broadcast and no task depends
on the size of the table or on a vector that many rows share.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm._vectors import integer_vectors
from plotline.operators.checkpoints import checkpointed

#: Bytes of the weights in a block of queries or of vectors.
BLOCK_BYTES = 8 << 20
PAIRS_SCHEMA = "query_row long, query_id long, row long, vec_id long, score long"


def _postings(weights: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every term the positions and weights of the vectors that have it."""
    lengths = np.array([len(w) for w in weights])
    flat = np.concatenate(weights) if len(weights) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(weights)), lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = flat != 0
    flat, owner, term = flat[kept], owner[kept], term[kept]
    order = np.argsort(term, kind="stable")
    flat, owner, term = flat[order], owner[order], term[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {
        int(t[0]): (o, w)
        for t, o, w in zip(np.split(term, cuts), np.split(owner, cuts), np.split(flat, cuts), strict=True)
        if len(t)
    }


def _select(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id, then to the smaller row."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(scores >= cut)
    else:
        chosen = np.arange(len(scores))
    return chosen[np.lexsort((rows[chosen], ids[chosen], -scores[chosen]))][:k]


def score_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of one block for every query of one block."""
    ids, rows = vectors["vec_id"].to_numpy(np.int64), vectors["row"].to_numpy(np.int64)
    postings = _postings([np.asarray(w, np.int64) for w in vectors["weights"]])
    found: dict[str, list] = {c.split()[0]: [] for c in PAIRS_SCHEMA.split(", ")}
    for row, query, weights in zip(queries["row"], queries["vec_id"], queries["weights"], strict=True):
        scores = np.zeros(len(ids), np.int64)
        weights = np.asarray(weights, np.int64)
        for term in np.flatnonzero(weights):
            if int(term) in postings:
                at, posting = postings[int(term)]
                scores[at] += weights[term] * posting
        others = np.flatnonzero(rows != row)
        best = others[_select(scores[others], ids[others], rows[others], k)]
        for c, v in zip(found, (np.full(len(best), row, np.int64), np.full(len(best), query, np.int64), rows[best], ids[best], scores[best]), strict=True):
            found[c].append(v)
    return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in found.items()})


def top_k(
    df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, scale: int = 1024,
    query_block: int | None = None, vector_block: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the highest integer inner product.

    ``is_query`` is a condition on ``vec_id``. Every row but the query's own is a candidate, also one that
    repeats it. Equal scores rank by the smaller id. Vectors that are null or hold a null or
    non-finite component, and null ids, take no part; an empty vector scores 0 with every other;
    of vectors of unequal length the missing components count as 0. Rows that repeat an id are separate
    candidates, and separate queries, whose results are returned for each. Fewer than k candidates give fewer
    rows; an empty table gives none. Inner products must fit 64 bits. Other columns are ignored.
    Weights are written once, under a number for each row; blocks hold as many rows as ``BLOCK_BYTES`` allows
    for the longest vector, unless they are given, so that vectors are copied once for every block of queries.
    """
    vectors = checkpointed(integer_vectors(df, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()))
    queries = vectors.where(is_query)
    sizes = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.coalesce(F.max(F.size("weights")), F.lit(0)).alias("d")).first()
    rows = max(1, BLOCK_BYTES // (8 * max(1, sizes["d"])))
    vector_blocks = max(1, math.ceil(sizes["n"] / (vector_block or rows)))
    query_blocks = max(1, math.ceil(sizes["q"] / (query_block or rows)))
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.withColumn("qb", deal(query_blocks)).withColumn("vb", spread(vector_blocks))
    right = vectors.withColumn("vb", deal(vector_blocks)).withColumn("qb", spread(query_blocks))

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return score_block(q, v, k)

    partial = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(best, PAIRS_SCHEMA)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best for every ``embeddings`` row whose vec_id is divisible by 100, against all rows."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS q, q.vec_id AS query_id, c.row AS c, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
