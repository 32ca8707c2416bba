"""Sharding, top-k search, and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotline.llm import queries
from plotline.llm.sharding import assign_shards
from plotline.llm.topk_search import top_k
from tests.llm.conftest import prose


def lawful(rows, shards):
    """Counts at most one apart, slots gapless."""
    held = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in held.values()) and sum(map(len, held.values())) == len(rows)
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows_are_laid_evenly(odd, no_rows, shards):
    rows = assign_shards(odd, "doc_id", "text", shards).collect()
    lawful(rows, shards)
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"]) for r in rows))) == sorted(str((d, len(t.encode()) + 16, zlib.crc32(t.encode()))) for d, t in texts)
    assert assign_shards(no_rows, "doc_id", "text", shards).count() == 0


def test_copies_meet(spark):
    r = random.Random(5)
    texts = [f"t{r.randrange(60)}" for _ in range(600)] + ["hot"] * 300 + [f"own{i}" for i in range(900)]
    rows = assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 12).collect()
    lawful(rows, 12)
    places = {}
    for row in rows:
        places.setdefault(texts[row["doc_id"]], Counter())[row["shard"]] += 1
    uncut = {t: sum(n * n for n in p.values()) / p.total() ** 2 for t, p in places.items()}
    # Share of a group's edges inside shards: at random 1/12; at best 1, and 1/2 for the one that two shards hold.
    assert np.mean([u for t, u in uncut.items() if t.startswith("t")]) > 0.9 and uncut["hot"] > 0.25


def test_documents_are_laid_evenly(spark, sf_dir):
    rows = queries.QUERIES["op7_sharding"](spark, sf_dir).collect()
    lawful(rows, 40)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(d, len(t) + 16, zlib.crc32(t)) for d, t in texts.items()}


def test_top_k_equals_brute_force(spark):
    rng = random.Random(2)
    vectors = [(i, [round(rng.uniform(-1, 1), 1) if rng.random() < 0.6 else 0.0 for _ in range(5)]) for i in range(300)]
    vectors += [(900, None), (1000, [1.0, None]), (1100, [float("nan")] * 5), (1200, [float("inf")] * 5), (None, [1.0] * 5), (7, vectors[7][1]), (1300, [])]
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<double>, score int")
    vectors += [vectors[10], vectors[10], (20, vectors[11][1])]
    df = spark.createDataFrame([(*v, 0) for v in vectors], "vec_id long, embedding array<double>, score int")
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (q, qw) in enumerate(whole):
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(qw, w)), i) for b, (i, w) in enumerate(whole) if a != b)[:7]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    found = top_k(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, k=7, query_block=9, vector_block=40).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert top_k(df.where("false"), "vec_id", "embedding", F.col("vec_id") % 10 == 0).count() == 0


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns, name
        if name == "quality classifier":
            assert len(good & {r["doc_id"] for r in kept.collect()}) > 0.95 * len(good)
    assert corpus_pipeline.run(spark, sf_dir).where("not round_trip").count() == 0


def test_stages_on_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert all(stage(spark, docs, sf_dir).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_one_of_each_group_of_copies_stays_whatever_the_ids(spark):
    a, b, c = (prose(i + 300, 60) for i in range(3))
    rows = [(2, a), (2, a), (1, a), (1, b), (None, c), (None, c), (None, a), (7, None), (7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_copies(spark, docs, None)
    want = [(1, a), (1, b), (7, None), (7, None), (None, ""), (None, c)]
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
