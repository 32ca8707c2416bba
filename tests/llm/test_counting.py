"""Hard negatives, token counts and clustering."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotline.llm import queries
from plotline.llm.clustering import assign, lloyd
from plotline.llm.hard_negatives import mine
from plotline.llm.token_counts import chunk_bounds, count_tokens
from tests.oracle import rows_of, rows_of_sql

LIBRARY = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_centroid_clustering"])
def test_vector_queries_match_their_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(queries.ORACLE_SQL[name], sf_dir)


def vectors(seed, n, d, ids):
    rng = random.Random(seed)
    rows = [(ids(i), [round(rng.uniform(-1, 1), 1) for _ in range(d)], rng.randrange(3)) for i in range(n)]
    rows += [rows[3], rows[3], rows[10], (rows[10][0], rows[11][1], 0)]
    odd = [(900, None, 1), (1000, [1.0, None], 1), (1100, [float("nan")] * d, 1), (1200, [float("inf")] * d, 1), (None, [1.0] * d, 1), (1300, [0.5] * d, None)]
    return rows, odd


def test_negatives_equal_brute_force(spark):
    rows, odd = vectors(3, 150, 5, lambda i: i)
    rows += [(400, [0.5, -0.25], 1), (410, [], 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<double>, label int, score int").repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    usable = [(i, (g + 1) % 3 if i % 7 == 0 else g, [int(np.floor(256 * x)) for x in v]) for i, v, g in rows]
    want = []
    for a, (anchor, own, av) in enumerate(usable):
        if anchor % 10:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, g) for b, (i, g, v) in enumerate(usable) if b != a]
        ranked = sorted(scored, key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in ranked if s[2] == own][:5]:
            inside = [s for s in ranked if s[2] != own and 30 * ps <= 100 * s[0] <= 90 * ps][:4]
            want += [(anchor, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(inside, 1)]
    for wave_bytes in (1 << 20, 900):
        found = mine(df, "vec_id", "embedding", label, F.col("vec_id") % 10 == 0, negatives=4, wave_bytes=wave_bytes).collect()
        assert sorted(map(tuple, found)) == sorted(want)
    assert mine(df.where("false"), "vec_id", "embedding", label, F.col("vec_id") % 10 == 0).count() == 0
    assert mine(df.where("label = 1"), "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0).count() == 0


def test_large_products_stay_exact(spark):
    big = 2.0**20 + 1
    rows = [(0, [big, 1.0], 0), (1, [big, 3.0], 0), (2, [0.9 * big, 5.0], 1), (3, [0.9 * big, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    found = mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") == 0).orderBy("rank").collect()
    inside = [n for n in (2, 3) if 30 * dot(0, 1) <= 100 * dot(0, n) <= 90 * dot(0, 1)]
    assert [tuple(r)[3:] for r in found] == [(n, dot(0, 1), dot(0, n)) for n in sorted(inside, key=lambda n: -dot(0, n))]


def floor_mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows)]


def test_clusters_equal_brute_force(spark):
    rows, odd = vectors(4, 120, 4, lambda i: i)
    df = spark.createDataFrame([(*r, 0) for r in rows + odd + [(500, [1.0] * 3, 0)]], "vec_id long, embedding array<double>, label int, cluster int").repartition(3)
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows + [odd[-1]]]
    drawn = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in drawn[:6]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(3):
        groups = [[v for _, v in kept if nearest(v)[1] == k] for k in range(6)]
        centroids = [floor_mean(g) if g else c for g, c in zip(groups, centroids)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, k, d in placed if k == c) for c in range(6)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = sorted((i, k, d, inertia[k], sum(inertia), digest[k]) for i, k, d in placed)
    assert sorted(map(tuple, lloyd(df, "vec_id", "embedding", clusters=6, width=4).collect())) == want
    assert lloyd(df.where("vec_id < 3"), "vec_id", "embedding", clusters=6, width=4).select("cluster").distinct().count() <= 3
    assert lloyd(df.where("false"), "vec_id", "embedding").collect() == [] and lloyd(df, "vec_id", "embedding").count() == 0


def test_ties_take_the_lowest_centroid():
    nearest, distance = assign(np.array([[1], [5]]), np.array([[0], [2], [2], [9]]))
    assert nearest.tolist() == [0, 1] and distance.tolist() == [1, 9]


def test_chunks_cover_a_text():
    for length in (1, 5, 16, 17, 40, 100):
        bounds = chunk_bounds(length, 16, 4)
        assert bounds[0][0] == 0 and bounds[-1][1] == length
        assert all(b[0] == a[0] + 12 and a[1] - b[0] == 4 for a, b in zip(bounds, bounds[1:]))


def hostile(seed, n):
    """Runs of white space, contractions, cut special strings, scripts without spaces and long words."""
    r = random.Random(seed)
    some = ["<|endoftext|>", "<|endof", "text|>", "<|", "'ll", "'re", "'s", "'", "it's", "we'll", "  ", " ", "\n\n", " \n ", "\t", "a" * r.randrange(1, 60), "日本語", "١٢٣", "éa", "😀", "12345", "!?", " word", "Mixed", " ", "\x00"]
    return "".join(r.choice(some) for _ in range(n))


def test_spliced_counts_are_the_librarys(spark):
    texts = [hostile(i, 200) for i in range(60)] + ["x" * 3000, "x y " * 900, " " * 2500, "<|endoftext|>" * 200, "ab " * 20 + "q" * 900 + " cd" * 50]
    texts += [texts[0], texts[0], "", None, "a", "日" * 1500 + "。" + "本" * 700]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0)], "doc_id long, text string, n_tokens int").repartition(3)
    for chunk, overlap in ((128, 32), (400, 100), (1 << 15, 1 << 10)):
        found = count_tokens(df, "doc_id", "text", 100, chunk=chunk, overlap=overlap).collect()
        want = []
        for i, t in [*enumerate(texts), (None, texts[0])]:
            n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
            want.append((i, len((t or "").encode()), n, n > 100))
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert count_tokens(df.where("false"), "doc_id", "text").count() == 0


def test_token_counts_of_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.QUERIES["op12_token_counts"](spark, sf_dir).collect()
    want = {(d, len(t.encode()), n := len(LIBRARY.encode(t, add_special_tokens=False).ids), n > 512) for d, t in texts.items()}
    assert {tuple(r) for r in found} == want and len(found) == len(texts)
