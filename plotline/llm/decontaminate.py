"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the number of their word shingles. An item's sketch is its shingles of least hash; it
has as many as the containment threshold allows to be missing, plus one: a document that holds at least ``threshold`` of the item's shingles then
holds one of the sketch's, so that the search misses nothing. Documents too small for a partition skip
it. An item of fewer words than a shingle is one shingle of its own width, and documents are cut to shingles
of the widths that such items have as well. Documents and sketches meet by hash in a join of Spark's, and each pair is verified by exact shingle
containment over the whole texts. Neither items nor documents pass through the driver; up to
``MAX_HASHES`` sketch hashes are carried to the tasks, so that only documents which hold one of them
take part in the join, and beyond that all shingles do.
"""

from __future__ import annotations

from hashlib import md5
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm._text import SHINGLE_WORDS, arrow_pass, as_bytes, hash_shingles, hash_words, list_of, words_of
from plotline.operators.checkpoints import checkpointed

THRESHOLD = 0.8
#: Sketch hashes that tasks are given at most, 12 bytes each.
MAX_HASHES = 1 << 22
#: Digests of documents to drop that are broadcast at most, 16 bytes each.
MAX_DIGESTS = 1 << 18
_BITS = 20
ITEMS_SCHEMA = "item_id long, text binary, hashes array<long>, width int"
FOUND_SCHEMA = "doc_id long, n int, hits array<long>, packed binary"
PAIRS_SCHEMA = "doc_id long, item_id long, item_shingles int, shared int"


def exact_shingles(words: list[bytes], width: int = SHINGLE_WORDS) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def _item_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [hash_words(words_of(t)) for t in batch.column(1).to_pylist()]
    hashes = [np.unique(hash_shingles(w)).view(np.int64) for w in words]
    width = pa.array([min(len(w), SHINGLE_WORDS) for w in words], pa.int32())
    return pa.record_batch([*batch.columns, list_of(hashes, pa.int64()), width], names=["item_id", "text", "hashes", "width"])


def sketched_items(items: DataFrame, item_id_col: str, item_text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Distinct items ``item, item_id, text, needed`` and their sketches ``hash, item, least``, both written.

    ``needed`` is the number of shingles that a hit shares; ``least`` the fewest that a document of any
    hit in the item's size partition has.
    """
    distinct = as_bytes(items, item_id_col, item_text_col).where("text is not null").distinct()
    known = arrow_pass(distinct.select(F.col("doc_id").alias("item_id"), "text"), _item_shingles, ITEMS_SCHEMA)
    needed = lambda n: F.ceil(F.round(F.lit(threshold) * n, 9)).cast("int")
    n = F.size("hashes")
    known = checkpointed(known.where(n > 0).select(
        F.monotonically_increasing_id().alias("item"), "item_id", "text", "hashes", "width", needed(n).alias("needed"),
        needed(F.pow(F.lit(2.0), F.floor(F.log2(n)))).alias("least"), n.alias("n"),
    ))
    each = known.select("item", "n", "needed", "least", F.explode("hashes").alias("hash"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("hash"))
    sketches = each.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.col("needed") + 1)
    return known.drop("hashes", "n", "least"), checkpointed(sketches.select("hash", "item", "least"))


class Filter:
    """Sketch hashes and the fewest shingles that a document needs for any hit by each."""

    def __init__(self, hashes: np.ndarray, least: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.least = hashes[order], least[order]
        self.smallest = int(least.min()) if len(least) else 0
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.hashes & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        maybe = np.unique(shingles[self.seen[shingles & np.uint64((1 << _BITS) - 1)]])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, maybe), len(self.hashes) - 1)
        return maybe[(self.hashes[at] == maybe) & (self.least[at] <= len(shingles))]


def _widths(known: DataFrame, inside: int) -> list[int]:
    """Numbers of words of the items that are shorter than a shingle and of ``inside`` words or more."""
    return sorted(r[0] for r in known.where((F.col("width") >= inside) & (F.col("width") < SHINGLE_WORDS)).select("width").distinct().collect())


def _found(documents: DataFrame, sketches: DataFrame, max_hashes: int, widths: list[int]) -> DataFrame:
    """Documents that hold a sketch hash, numbered, with these hashes and the compressed text; written.

    Hashes are those of a document's shingles and of its runs of as many words as ``widths`` say.
    """
    each = sketches.groupBy("hash").agg(F.min("least").alias("least"))
    index = None
    if each.count() <= max_hashes:
        table = each.toArrow()
        index = Filter(table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy())
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        index, pack = shared.value, zstandard.ZstdCompressor(level=3).compress
        ids, sizes, found, texts = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = hash_words(words_of(text))
            shingles = hash_shingles(words)
            if not len(shingles) or index and len(shingles) < index.smallest:
                continue
            each = [shingles, *(hash_shingles(words, w) for w in widths if w < min(len(words), SHINGLE_WORDS))]
            hits = np.unique(np.concatenate([index.hits(h) for h in each] if index else each))
            if len(hits):
                ids.append(doc_id)
                sizes.append(len(shingles))
                found.append(hits.view(np.int64))
                texts.append(pack(text))
        if not ids:
            return None
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), list_of(found, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "n", "hits", "packed"])

    return checkpointed(arrow_pass(documents, find, FOUND_SCHEMA).withColumn("row", F.monotonically_increasing_id()))


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    unpack, rows, last, words, own = zstandard.ZstdDecompressor().decompress, [], None, [], {}
    for doc_id, packed, item_id, item, needed, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if packed != last:
            last, words, own = packed, words_of(unpack(packed)), {}
        if width not in own:
            own[width] = exact_shingles(words, width)
        wanted = exact_shingles(words_of(item))
        if (shared := len(wanted & own[width])) >= needed:
            rows.append((doc_id, item_id, len(wanted), shared))
    if not rows:
        return None
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "item_shingles", "shared"])


def contained_items(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str,
    threshold: float = THRESHOLD, max_hashes: int = MAX_HASHES, inside: int = 1,
) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared``: items of which a document holds ``threshold`` or more.

    Shingles are five lower-cased words. An item of fewer words is one shingle, which a document holds that has
    these words in a row; with fewer than ``inside`` words it is found in equal texts only. A null or empty document or item holds nothing and is contained nowhere.
    Repeated documents give repeated rows; repeated items count once; a null id stays null. Empty tables
    give an empty result; other columns are ignored.
    """
    known, sketches = sketched_items(items, item_id_col, item_text_col, threshold)
    found = _found(as_bytes(docs, id_col, text_col), sketches, max_hashes, _widths(known, inside))
    pairs = found.select("row", "n", F.explode("hits").alias("hash")).join(sketches, "hash").where("n >= least").select("row", "item").distinct()
    both = pairs.join(found.select("row", "doc_id", "packed"), "row").join(known, "item")
    return arrow_pass(both.select("doc_id", "packed", "item_id", "text", "needed", _looked(inside)), _verify, PAIRS_SCHEMA)


def _looked(inside: int):
    """The width of the shingles among which an item is looked for."""
    return F.when(F.col("width") >= inside, F.col("width")).otherwise(SHINGLE_WORDS).alias("width")


def without_items(docs: DataFrame, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, threshold: float = THRESHOLD, max_hashes: int = MAX_HASHES, inside: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay as they are.

    Items of fewer than ``inside`` words are found in equal texts only, as words such as "yes" stand in clean documents.

    Texts stand for rows: equal texts contain the same items. A null text stays.
    """
    known, sketches = sketched_items(items, item_id_col, item_text_col, threshold)
    found = _found(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), sketches, max_hashes, _widths(known, inside))
    pairs = found.select("row", "n", F.explode("hits").alias("hash")).join(sketches, "hash").where("n >= least").select("row", "item").distinct()
    both = pairs.join(found.select("row", "packed"), "row").join(known, "item").select("row", "packed", "item_id", "text", "needed", _looked(inside))
    bad = arrow_pass(both, _verify, PAIRS_SCHEMA).select(F.col("doc_id").alias("row")).distinct()

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        return pa.record_batch([pa.array([md5(unpack(p)).digest() for p in batch.column(0).to_pylist()], pa.binary())], names=["digest"])

    gone = checkpointed(arrow_pass(found.join(bad, "row").select("packed"), digests, "digest binary").distinct())
    column = f"digest_{uuid4().hex}"
    gone = gone.withColumnRenamed("digest", column)
    if gone.count() <= MAX_DIGESTS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.unhex(F.md5(F.col(text_col).cast("binary"))) == F.col(column), "left_anti").select(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` row against every ``benchmark`` item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contained_items(docs, "doc_id", "text", items, "item_id", "text").withColumn(
        "containment", F.round(F.col("shared") / F.col("item_shingles"), 6)
    )


OP9_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark
), w AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t
), s AS (
  SELECT side, id, CASE WHEN len(ws) >= 5
    THEN list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')))
    ELSE [array_to_string(ws, ' ')] END AS sh FROM w WHERE len(ws) > 0
), b AS (SELECT id AS item_id, len(sh) AS q, unnest(sh) AS g FROM s WHERE side = 'b'),
k AS (SELECT DISTINCT len(ws) AS width FROM w WHERE side = 'b' AND len(ws) BETWEEN 1 AND 4),
d AS (SELECT id AS doc_id, unnest(sh) AS g FROM s WHERE side = 'd'
  UNION ALL SELECT id, unnest(list_distinct(list_transform(generate_series(1, len(ws) - width + 1), lambda i: array_to_string(ws[i:i + width - 1], ' '))))
  FROM w JOIN k ON width < len(ws) WHERE side = 'd')
SELECT doc_id, item_id, CAST(q AS INTEGER) AS item_shingles, CAST(count(*) AS INTEGER) AS shared, round(count(*) / q, 6) AS containment
FROM b JOIN d USING (g) GROUP BY doc_id, item_id, q HAVING count(*) >= ceil(round(0.8 * q, 9))
"""
