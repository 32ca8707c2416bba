"""Plain Lloyd iterations on integer vectors.

The centroids, k times d integers, are broadcast. Tasks compute the squared differences to each of them
in NumPy, take the lowest of the nearest and emit one row of sums per partition and centroid; a
``groupBy`` merges these, so that the driver sees k rows a round. The vectors are made integers once, in
a written table that every round reads again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm._vectors import integer_vectors, matrix
from plotline.operators.checkpoints import checkpointed

#: Entries of the broadcast centroids at most.
MAX_ENTRIES = 1 << 22
#: Rows whose distances are computed at once.
ROWS = 4096


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every row, the smaller number on ties, and the squared distance."""
    distance = np.empty((len(centroids), len(vectors)), np.int64)
    for k, centroid in enumerate(centroids):
        away = vectors - centroid
        np.einsum("ij,ij->i", away, away, out=distance[k])
    nearest = distance.argmin(axis=0)
    return nearest, distance[nearest, np.arange(len(vectors))]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at : at + ROWS]
            yield part["vec_id"].to_numpy(np.int64), matrix(part["weights"])


def _totals(vectors: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """Count, summed distance and componentwise sum of the vectors of each centroid."""
    k, d = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, rows in _parts(batches):
            nearest, distance = assign(rows, shared.value)
            count += np.bincount(nearest, minlength=k)
            for c in np.unique(nearest):
                own = nearest == c
                inertia[c] += distance[own].sum()
                sums[c] += rows[own].sum(axis=0)
        seen = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": seen.astype(np.int32), "n": count[seen], "inertia": inertia[seen], "sums": list(sums[seen])})

    merged = (
        vectors.mapInPandas(summed, "cluster int, n long, inertia long, sums array<long>").groupBy("cluster")
        .agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"))
    )
    found = {r["cluster"]: (r["n"], r["inertia"], r["sums"]) for r in merged.collect()}
    shared.destroy()
    return [found.get(c, (0, 0, [0] * d)) for c in range(k)]


def lloyd(
    df: DataFrame, id_col: str, vector_col: str, clusters: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, one row per kept vector.

    Kept are vectors of exactly ``width`` components, none of them null or non-finite, with an id. The
    first centroids are those of the smallest SHA-256 of ``seed:vec_id``; rows that repeat an id rank by
    their components. A round moves every centroid that has vectors to the floor of their mean, exactly;
    one without stays. Repeated rows count as often as they occur. Fewer vectors than ``clusters`` give
    as many centroids as there are; none give no rows. Vectors whose integers are so large that a distance
    might not fit 64 bits take no part; the sums of distances must fit them. Other columns are ignored.
    """
    spark = df.sparkSession
    if clusters * width > MAX_ENTRIES:
        raise ValueError(f"{clusters} centroids of {width} components are more than {MAX_ENTRIES} entries")
    most = int((2**62 / max(1, width)) ** 0.5) // 2
    sound = (F.size("weights") == width) & F.forall("weights", lambda w: w.between(-most, most))
    kept = checkpointed(integer_vectors(df, id_col, vector_col, scale).where(sound))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(drawn, "weights").limit(clusters).select("weights").collect()
    centroids = np.array([r["weights"] for r in first], np.int64).reshape(len(first), width)
    if len(first):
        for _ in range(rounds):
            totals = _totals(kept, centroids)
            centroids = np.array([[s // n for s in sums] if n else list(old) for (n, _, sums), old in zip(totals, centroids.tolist(), strict=True)], np.int64)
        totals = _totals(kept, centroids)
    else:
        totals = []
    inertias = np.array([t[1] for t in totals], np.int64)
    whole = sum(t[1] for t in totals)
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)
    shared = spark.sparkContext.broadcast((centroids, inertias, digests))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, inertias, digests = shared.value
        for ids, rows in _parts(batches):
            nearest, distance = assign(rows, centroids)
            yield pd.DataFrame({"vec_id": ids, "cluster": nearest.astype(np.int32), "distance": distance, "cluster_inertia": inertias[nearest], "inertia": np.full(len(ids), whole), "centroid_sha256": digests[nearest]})

    return kept.mapInPandas(placed, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all ``embeddings`` after three rounds."""
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def lloyd_sql(clusters: int = 16, rounds: int = 3) -> str:
    """DuckDB SQL of the query: one assignment and one mean per round."""
    parts = [f"""v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), w) - 1 AS c, w FROM v ORDER BY sha256('1:' || vec_id), w LIMIT {clusters}
)"""]
    nearest = """a{i} AS (
  SELECT row, vec_id, v.w, min(({{'d': CAST(list_sum(list_transform(list_zip(v.w, k.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': k.c}})) AS m
  FROM v, c{i} k GROUP BY row, vec_id, v.w
)"""
    for i in range(rounds):
        parts.append(nearest.format(i=i))
        parts.append(f"""s{i} AS (
  SELECT c, pos, CAST(floor_sum AS BIGINT) AS x FROM (
    SELECT m.c AS c, pos, (sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS floor_sum
    FROM (SELECT m, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM a{i}) GROUP BY m.c, pos)
), c{i + 1} AS (
  SELECT k.c, coalesce(n.w, k.w) AS w FROM c{i} k LEFT JOIN (SELECT c, list(x ORDER BY pos) AS w FROM s{i} GROUP BY c) n USING (c)
)""")
    parts.append(nearest.format(i=rounds))
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} k ON k.c = m.c
"""


OP13_SQL = lloyd_sql()
