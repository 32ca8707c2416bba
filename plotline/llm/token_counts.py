"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

Texts of up to ``CHUNK`` characters are encoded as they are. Longer ones are cut into chunks of that many
characters that overlap; the chunks are dealt to all tasks and encoded there, with offsets. The library
splits a text into words before it merges bytes, tokens never cross words, and where a word starts depends
on the text from there on alone. So a start of a word that two neighbouring chunks both have is a place at
which the whole text's encoding can be spliced, if it is one of the whole text: a word of the left chunk
is one of the whole text if the word before it is and the chunk shows ``margin`` more characters after
it, as no rule looks farther ahead. The first chunk starts with the text, so by induction all splices are
proven. Where an overlap has no such place (a word as long as the overlap), the text is cut anew with chunks
and overlaps eight times as wide, until it agrees or is one chunk.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer

from plotline.llm._text import arrow_pass, give_back, list_of
from plotline.llm._vocabulary import TOKENIZERS, broadcast_file, json_tokenizer
from plotline.operators.checkpoints import checkpointed

#: Characters of a chunk and of the overlap of two chunks, before they are widened by ``WIDER``.
CHUNK, OVERLAP, WIDER = 1 << 16, 1 << 10, 8
#: Characters encoded by one call of the library.
AT_ONCE = 1 << 17
#: Characters after a word's end that its match can depend on: three of a contraction, one after a run.
LOOKAHEAD = 4
CHUNK_SCHEMA = "key string, k long, text string, first boolean, last boolean"
COUNT_SCHEMA = "key string, k long, last boolean, n long, head array<long>, head_tokens array<long>, tail array<long>, tail_tokens array<long>"


def _tokenizer(file: Broadcast) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return json_tokenizer(file)


def margin_of(tokenizer: Tokenizer) -> int:
    """Characters that a chunk must show after a word for the word to be one of the whole text."""
    added = tokenizer.get_added_tokens_decoder().values()
    return max([LOOKAHEAD, *(len(t.content) for t in added)])


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``AT_ONCE`` characters."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def word_starts(encoding: Encoding, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters from ``low`` to ``high`` at which a word starts, and the number of tokens before each.

    Only the tokens of that part are looked at, from the nearer end of the text.
    """
    n, found = len(encoding), []
    if low <= 0:
        for t in range(n):
            start = encoding.token_to_chars(t)[0]
            if start > high:
                break
            if t == 0 or encoding.token_to_word(t) != encoding.token_to_word(t - 1):
                found.append((start, t))
    else:
        for t in range(n - 1, -1, -1):
            start = encoding.token_to_chars(t)[0]
            if start < low:
                break
            if start <= high and (t == 0 or encoding.token_to_word(t) != encoding.token_to_word(t - 1)):
                found.append((start, t))
    places = np.array(sorted(found), np.int64).reshape(-1, 2)
    return places[:, 0], places[:, 1]


def chunk_bounds(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of overlapping chunks; the last one ends with the text."""
    starts = range(0, max(1, length - overlap), chunk - overlap)
    return [(s, min(s + chunk, length)) for s in starts]


def _chunks(long_texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of every text, dealt to all tasks; repeated texts are cut once in every task that has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"]):
                text = text.as_py()
                bounds = chunk_bounds(len(text), chunk, overlap)
                for k, (start, end) in enumerate(bounds):
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": [k], "text": [text[start:end]], "first": [k == 0], "last": [k == len(bounds) - 1]})
        give_back()

    return long_texts.mapInArrow(cut, CHUNK_SCHEMA).repartition("key", "k")


def _encoded(chunks: DataFrame, file: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """Tokens of every chunk, and the starts of words in its two overlaps with the tokens before them."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(file)
        margin = margin_of(tokenizer)
        found: dict[str, list] = {c: [] for c in ("n", "head", "head_tokens", "tail", "tail_tokens")}
        texts, at = batch["text"].to_pylist(), 0
        for part in _slices(texts):
            for text, encoding in zip(part, tokenizer.encode_batch(part, add_special_tokens=False)):
                start = batch["k"][at].as_py() * (chunk - overlap)
                # A start of a word is where the word before it ends.
                head, before_head = word_starts(encoding, 0, overlap)
                tail, before_tail = word_starts(encoding, max(1, len(text) - overlap), len(text) - margin)
                for c, v in zip(found, (len(encoding), head + start, before_head, tail + start, before_tail)):
                    found[c].append(v)
                at += 1
        lists = [list_of(found[c], pa.int64()) for c in ("head", "head_tokens", "tail", "tail_tokens")]
        return pa.RecordBatch.from_arrays([batch["key"], batch["k"], batch["last"], pa.array(found["n"], pa.int64()), *lists], names=[c.split()[0] for c in COUNT_SCHEMA.split(", ")])

    return arrow_pass(chunks, count, COUNT_SCHEMA)


def spliced(parts: DataFrame) -> DataFrame:
    """``key, n_tokens`` of every text; null where two neighbouring chunks have no place in common."""
    left = parts.where("not last").select("key", "k", "tail", "tail_tokens", F.col("n").alias("left_n"))
    right = parts.where("k > 0").select("key", (F.col("k") - 1).alias("k"), "head", "head_tokens")
    both = left.join(right, ["key", "k"]).withColumn("place", F.array_min(F.array_intersect("tail", "head")))
    before = lambda side: F.element_at(f"{side}_tokens", F.array_position(side, F.col("place")).cast("int"))
    seams = both.select("key", F.col("place").isNull().alias("apart"), F.when(F.col("place").isNotNull(), before("tail") - F.col("left_n") - before("head")).alias("n"))
    whole = parts.select("key", F.lit(False).alias("apart"), "n").unionByName(seams)
    total = whole.groupBy("key").agg(F.bool_or("apart").alias("apart"), F.sum("n").alias("n"))
    return total.select("key", F.when(~F.col("apart"), F.col("n")).alias("n_tokens"))


def count_tokens(
    df: DataFrame, id_col: str, text_col: str, limit: int = 512, file: str = "byte_bpe_50k.json", folder: str = TOKENIZERS,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row: the library's tokens of the whole text.

    Strings of added tokens inside a text are those tokens, as is the library's default; nothing is added,
    cut or filled up. A null text counts as empty and has no tokens. Repeated rows are counted each; null
    ids stay; an empty table gives no rows; other columns are ignored. Texts of more than ``chunk``
    characters are known by their SHA-256 while they are cut and spliced. ``over_limit``: more than ``limit``.
    """
    if chunk < 4 * overlap:
        raise ValueError("a chunk must be at least four overlaps long")
    spark = df.sparkSession
    vocabulary = broadcast_file(spark.sparkContext, file, folder)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = _tokenizer(vocabulary)
        counts = [len(e) for part in _slices(batch["text"].to_pylist()) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    short = arrow_pass(docs.where(F.length("text") <= chunk).select("doc_id", "n_bytes", "text"), count, "doc_id long, n_bytes long, n_tokens long")
    keyed = docs.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    texts, counted = keyed.select("key", "text"), []
    while True:
        parts = _encoded(_chunks(texts, chunk, overlap), vocabulary, chunk, overlap)
        alike = parts.groupBy("key", "k").agg(*[F.first(c).alias(c) for c in parts.columns[2:]])
        totals = checkpointed(spliced(checkpointed(alike)))
        counted.append(totals.where("n_tokens is not null"))
        apart = totals.where("n_tokens is null").select("key")
        if apart.isEmpty():
            break
        chunk, overlap = chunk * WIDER, overlap * WIDER
        texts = keyed.select("key", "text").join(apart, "key", "left_semi")
    known = functools.reduce(DataFrame.unionByName, counted)
    long = keyed.select("doc_id", "n_bytes", "key").join(known, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents`` under the byte-level vocabulary."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
