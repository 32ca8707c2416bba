"""Removal of repeated passages by hashing units of text.

A unit is a sentence of a line (a line without sentence ends is one unit). A unit of more than
``LONG_UNIT`` words is cut further before words whose hash is the least of those ``REACH`` words around,
so that a passage is cut alike wherever it stands, also in the middle of a long sentence. Units are
normalised and hashed to 128 bits; light ones (under ``MIN_UNIT_WORDS`` words, or pieces under
``MIN_BLOCK_WORDS``) only together with their neighbours: a light unit goes where the block of
``MIN_BLOCK_WORDS`` words or more that begins or ends with it is repeated. Digests are grouped over all
documents and the occurrence of lowest rank (document id, then offset) stays. In a document,
neighbouring repeated units form a run. A run of at least ``min_words`` words is a repeated passage and
is removed; shorter ones, such as a licence line or a stock phrase, are left. A run ends with whole
units: up to one unit of a passage stays at either end, and a passage whose whole units have fewer than
``min_words`` words stays. Where light units repeat one after the other, the first stays. With a passage
goes the white space before it, and after it where nothing else is left on that side. Offsets refer to
the original text, in code points; what they leave is the text that is returned.
"""

from __future__ import annotations

import re
from itertools import accumulate, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from plotline.llm._text import arrow_pass, mix64
from plotline.operators.checkpoints import checkpointed

MIN_WORDS = 20
#: Units of fewer words repeat by chance; they are hashed with their neighbours, in blocks of MIN_BLOCK_WORDS.
MIN_UNIT_WORDS = 4
MIN_BLOCK_WORDS = 8
#: A unit of more words is cut before words whose hash is the least among REACH words on either side.
LONG_UNIT = 16
REACH = 4
_BREAK = re.compile(r"[.!?]+\s+|\s*\n\s*")
_LAST = (1 << 63) - 1
_WORD = re.compile(r"\S+")
PACKED_SCHEMA = "key long, rank long, doc_id long, packed binary"
UNITS_SCHEMA = "high long, low long, rank long, key long, block int"


def units_of(text: str) -> list[tuple[int, int]]:
    """Start and end of every unit that has a word; a sentence keeps its final marks."""
    found, at = [], 0
    for m in _BREAK.finditer(text):
        end = m.start() + len(m[0].rstrip())
        if text[at:end].strip():
            found.append((at, end))
        at = m.end()
    if text[at:].strip():
        found.append((at, len(text.rstrip())))
    return found


def cuts_of(words: list[str]) -> list[int]:
    """Where to cut a long unit: at words that their near surroundings alone choose."""
    h = list(map(crc32, map(str.encode, words)))
    return [
        i for i in range(REACH, len(h) - REACH)
        if h[i - 1] > h[i] <= h[i + 1] and h[i] == min(h[i - REACH : i + REACH + 1]) and h[i] not in h[i - REACH : i]
    ]


def blocks_of(text: str) -> tuple[list[tuple[int, int]], list[list[str]], list[tuple[int, int]], list[list[int]]]:
    """Units of a text, their words, the blocks to hash (first and last unit) and each unit's blocks, by number.

    A unit that isn't light is a block by itself. A light one has the block that begins with it and the one
    that ends with it, as far as the text has enough words.
    """
    units, words, light = [], [], []
    for start, end in units_of(text):
        own = text[start:end].lower().split()
        if len(own) > LONG_UNIT and (cuts := cuts_of(own)):
            spans = [m.span() for m in _WORD.finditer(text, start, end)]
            for i, j in pairwise((0, *cuts, len(own))):
                units.append((spans[i][0], spans[j - 1][1]))
                words.append(own[i:j])
                light.append(j - i < MIN_BLOCK_WORDS)
        else:
            units.append((start, end))
            words.append(own)
            light.append(len(own) < MIN_UNIT_WORDS)
    blocks = [(i, i) for i, x in enumerate(light) if not x]
    shared: dict[int, list[tuple[int, int]]] = {}
    upto = [0, *accumulate(map(len, words))]
    for i in (i for i, x in enumerate(light) if x):
        h, j = i, i
        while j < len(units) - 1 and upto[j + 1] - upto[i] < MIN_BLOCK_WORDS:
            j += 1
        while h > 0 and upto[i + 1] - upto[h] < MIN_BLOCK_WORDS:
            h -= 1
        shared[i] = [(x, y) for x, y in ((i, j), (h, i)) if upto[y + 1] - upto[x] >= MIN_BLOCK_WORDS]
        blocks += shared[i]
    blocks = sorted(set(blocks))
    number = {b: k for k, b in enumerate(blocks)}
    return units, words, blocks, [[number[b] for b in shared[i]] if x else [number[i, i]] for i, x in enumerate(light)]


def digest(words: list[str]) -> tuple[int, int]:
    """The halves of the hash of normalised words: lower case, single spaces."""
    value = xxh3_128_intdigest(" ".join(words).encode())
    return value >> 64, value & 0xFFFFFFFFFFFFFFFF


def repeated_spans(text: str, repeats: set[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Spans to remove: runs of at least ``min_words`` words of units that have a repeated block, given by number."""
    units, words, _, own = blocks_of(text)
    gone = [any(b in repeats for b in mine) for mine in own]
    spans, i = [], 0
    while i < len(units):
        j = i
        while j < len(units) and gone[j]:
            j += 1
        if sum(map(len, words[i:j])) >= min_words:
            spans.append((units[i][0], units[j - 1][1]))
        i = max(j, i + 1)
    return spans


def with_space(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans with the white space that goes with them."""
    wide = []
    for start, end in spans:
        while start and text[start - 1].isspace():
            start -= 1
        rest = end
        while rest < len(text) and text[rest].isspace():
            rest += 1
        wide.append((start, rest if start == 0 or rest == len(text) else end))
    return wide


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """What the spans leave of a text."""
    bounds = [0, *(x for span in spans for x in span), len(text)]
    return "".join(text[i:j] for i, j in zip(bounds[::2], bounds[1::2], strict=True))


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts compressed, as they are written and travel."""
    pack = zstandard.ZstdCompressor(level=3).compress
    packed = [None if t is None else pack(t.encode()) for t in batch.column(3).to_pylist()]
    return pa.record_batch([*batch.columns[:3], pa.array(packed, pa.binary())], names=["key", "rank", "doc_id", "packed"])


def _unit_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Digests of the blocks of the rows ``key, rank, packed``, one row per block.

    Of the occurrences of a digest in the batch only the earliest can be the earliest of all. The others
    are repeats already: their numbers are sent as -1 - block, under a digest of their own, so that a digest
    which most documents have costs one row for each batch where the digests meet.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    halves, counts = [], []
    for packed in batch.column(2).to_pylist():
        _, words, blocks, _ = blocks_of(unpack(packed).decode()) if packed is not None else ([], [], [], [])
        halves += [digest(words[i] if i == j else [w for unit in words[i : j + 1] for w in unit]) for i, j in blocks]
        counts.append(len(blocks))
    high, low = (np.fromiter((h[k] for h in halves), np.uint64, len(halves)) for k in (0, 1))
    number = (np.arange(len(high)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    keys, ranks = (np.repeat(batch.column(k).to_numpy(), counts) for k in (0, 1))
    order = np.lexsort((number, keys, ranks, low, high))
    again = np.zeros(len(high), bool)
    again[order[1:]] = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
    high[again] = mix64(keys[again].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number[again].astype(np.uint64))
    low[again] = mix64(high[again])
    columns = [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(ranks), pa.array(keys), pa.array(np.where(again, -1 - number, number).astype(np.int32))]
    return pa.record_batch(columns, names=["high", "low", "rank", "key", "block"])


def drop_repeats(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, removed``: texts without repeated passages, and the removed spans.

    The earliest occurrence by (id, row, offset) stays whole, also within a document. Null ids rank last.
    Every row is a document of its own, also where ids are null or repeated: of rows that have an id and a
    text in common one keeps its text. A null text stays null, an empty one empty, with no spans. An empty
    table gives an empty result. Other columns are ignored. Rows are numbered and written to the checkpoint
    folder with their compressed texts, so that a number stays with its row; digests travel once, sorted by
    digest and place.
    """
    picked = df.select(
        F.monotonically_increasing_id().alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("rank"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
    )
    texts = checkpointed(arrow_pass(picked, _packed, PACKED_SCHEMA))
    units = arrow_pass(texts.select("key", "rank", "packed"), _unit_rows, UNITS_SCHEMA)
    order = Window.partitionBy("high", "low").orderBy("rank", "key", "block")
    later = units.withColumn("n", F.row_number().over(order)).where("n > 1 or block < 0")
    block = F.when(F.col("block") < 0, -1 - F.col("block")).otherwise(F.col("block"))
    repeats = later.select("key", block.alias("block")).groupBy("key").agg(F.collect_list("block").alias("repeats"))

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        texts, removed = [], []
        for packed, blocks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = None if packed is None else unpack(packed).decode()
            spans = with_space(text, repeated_spans(text, set(blocks), min_words)) if text and blocks else []
            texts.append(without_spans(text, spans) if spans else text)
            removed.append([{"start": s, "end": e} for s, e in spans])
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.list_(span))], names=["doc_id", "text", "removed"])

    joined = texts.select("key", "doc_id", "packed").join(repeats, "key", "left").select("doc_id", "packed", "repeats")
    return arrow_pass(joined, clean, "doc_id long, text string, removed array<struct<start:int,end:int>>")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without repeated passages; spans as start:end, comma-joined."""
    found = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed_spans"))
