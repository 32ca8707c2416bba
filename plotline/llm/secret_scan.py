"""Secret scans: named patterns, and a token-efficiency test for random strings.

Byte-pair vocabularies spell words in few tokens and random strings in many. A run of key-like
characters whose characters-per-token ratio is low is therefore a random string. Digests of known
lengths, UUIDs, numbers and timestamps are as inefficient but no secrets, and are excluded first.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm._text import arrow_pass
from plotline.llm._vocabulary import TOKENIZERS, broadcast_file, tiktoken_encoding

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH = 20
MAX_RATIO = 2.2
# The base patterns. Letters of the keyword match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
# Lengths in hex digits of common digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
_PLAIN = re.compile(r"[0-9T+/_=:-]+Z?")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the named patterns, code points, end exclusive, in no particular order."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def known_string(run: str) -> bool:
    """Digests, UUIDs, numbers and timestamps: inefficient to spell, but no secrets."""
    return bool(
        _HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run) or _PLAIN.fullmatch(run)
    )


def random_spans(text: str, count_tokens, taken: list[tuple[str, int, int]], min_length: int, max_ratio: float) -> list[tuple[str, int, int]]:
    """Key-like runs of at least ``min_length`` characters that need many tokens, outside ``taken``.

    Of a run that meets spans of ``taken`` the rest is tested: what follows such a span at any length, as
    the end of a secret, and what comes before the first only from ``min_length`` on, as it may be a name.
    """
    found = []
    for m in re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min_length).finditer(text):
        at, end = m.span()
        parts, least = [], min_length
        for _, s, e in sorted((x for x in taken if x[1] < end and at < x[2]), key=lambda x: x[1:]):
            if s - at >= least:
                parts.append((at, s))
            if e > at:
                at, least = e, 1
        if end - at >= least:
            parts.append((at, end))
        for s, e in parts:
            run = text[s:e]
            if not known_string(run) and len(run) <= max_ratio * count_tokens(run):
                found.append(("random", s, e))
    return found


def scan_text(text: str | None, count_tokens, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind; a null text has none."""
    if not text:
        return []
    base = base_spans(text)
    spans = base + random_spans(text, count_tokens, base, min_length, max_ratio)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _counter(file: Broadcast):
    encoding = tiktoken_encoding(file)
    return lambda run: len(encoding.encode_ordinary(run))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``doc_id, spans``: per row all spans (kind, start, end) in order, over the whole text.

    A null or empty text gives no spans; repeated rows are scanned each for itself; a null id stays
    null; an empty table gives an empty result; other columns are ignored. Spans of different kinds
    may overlap (a hex digest inside an assignment), added random spans overlap none.
    """
    file = broadcast_file(df.sparkSession.sparkContext, VOCABULARY, tokenizers)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = _counter(file)
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan_text(t, count, min_length, max_ratio)] for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_pass(picked, scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(df: DataFrame, text_col: str, mask: str = "[{kind}]", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by a mask of its kind; all else unchanged.

    Overlapping spans are replaced together, under the kind that starts first.
    """
    file = broadcast_file(df.sparkSession.sparkContext, VOCABULARY, tokenizers)
    at = df.columns.index(text_col)

    def clean(text: str | None, count) -> str | None:
        merged: list[list] = []
        for kind, start, end in scan_text(text, count):
            if merged and start < merged[-1][2]:
                merged[-1][2] = max(end, merged[-1][2])
            else:
                merged.append([kind, start, end])
        for kind, start, end in reversed(merged):
            text = text[:start] + mask.format(kind=kind) + text[end:]
        return text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = _counter(file)
        texts = pa.array([clean(t, count) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        return batch.set_column(at, batch.schema.field(at), texts)

    return arrow_pass(df, run, df.schema)


def _joined(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every ``documents`` row."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans")
    )
