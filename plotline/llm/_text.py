"""Words, shingles and Arrow passes shared by the text operators.

A word is a run of bytes outside ``\\x20\\x09-\\x0D`` of the UTF-8 text with A-Z lower-cased, which is
what ``bytes.lower().split()`` gives. Words and shingles are carried as 64-bit hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

SHINGLE_WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def hash_shingles(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the runs of ``width`` words, in order; a shorter text is one shingle, no word none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = words[:n].copy()
    for k in range(1, width):
        out *= _MULTIPLIER
        out += words[k : k + n]
    out += np.uint64(width)
    return mix64(out)


def shingle_set(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(hash_shingles(hash_words(words_of(text)), width))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a worker, and all it holds, for later tasks."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def arrow_pass(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``fn`` to every Arrow batch of ``df``; batches are bounded in rows and bytes by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
            out = None
        give_back()

    return df.mapInArrow(run, schema)


def as_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` only, the text as UTF-8 bytes; other columns may have any name."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def list_of(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per array, without a Python object per value."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
