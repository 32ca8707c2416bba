"""Quality classifier trained from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation
over the counts of all vote patterns estimates each labeller's accuracy and the share of good documents,
without any label given, and so the posterior of every pattern. Posterior labels of a bounded sample
train a linear scorer on hashed features of the whole text, its words and the shapes between them, which
then scores every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm._text import arrow_pass, give_back, hash_shingles, hash_words, words_of
from plotline.operators.checkpoints import checkpointed

#: Documents that the scorer is fitted on, at most; chosen by a hash of the row from all documents.
SAMPLE = 8_000
#: Entries of their features at most, 8 bytes each.
ENTRIES = 1 << 23
#: Buckets of hashed shapes, of hashed words, and two features of their own behind these.
SHAPE_BUCKETS, WORD_BUCKETS = 1 << 12, 1 << 14
BUCKETS = SHAPE_BUCKETS + WORD_BUCKETS + 2
ABSTAIN, BAD, GOOD = 0, 1, 2
KEEP_AT = 0.5
EM_ROUNDS = 50

# Classes of UTF-8 bytes; bytes of characters beyond ASCII count as lower-case letters.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, CRY, PAIR, BAR, SIGN = range(1, 12)
#: Runs of two or more of these have a class of their own.
DOUBLED = {STOP: 12, CRY: 13, SIGN: 14, UPPER: 15}


def _byte_classes() -> np.ndarray:
    table = np.full(256, SIGN, np.uint8)
    table[128:] = LOWER
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t\x0b\x0c", SPACE), (b"\n\r", LINE), (b".", STOP), (b",;:", COMMA), (b"!?", CRY), (b"'\"()-", PAIR), (b"|", BAR)):
        table[list(chars)] = kind
    return table


_CLASSES = _byte_classes()
_DOUBLE = np.arange(16, dtype=np.uint8)
_DOUBLE[list(DOUBLED)] = list(DOUBLED.values())


def class_runs(text: bytes) -> np.ndarray:
    """Classes of the runs of equal byte class of a text, in order."""
    classes = _CLASSES[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    lengths = np.diff(np.append(starts, len(classes)))
    runs = classes[starts]
    return np.where(lengths > 1, _DOUBLE[runs], runs)


@dataclass(frozen=True)
class Stats:
    """Figures of a whole text, as shares of its words."""

    words: int
    marked: float  # runs of two or more signs, such as ***
    shouted: float  # runs of two or more capitals
    lower: float  # words that begin with a lower-case letter
    signs: float  # runs of signs and bars of any length
    cells: float  # bars
    cried: float  # runs of two or more ! or ?
    stops: float  # sentence ends and commas
    echoed: float  # words equal to the word before
    novel: float  # distinct pairs of words


def text_stats(text: bytes) -> Stats:
    words = hash_words(text.split())
    n = max(1, len(words))
    runs = class_runs(text)
    counts = np.bincount(runs, minlength=16) / n
    first = np.concatenate([[True], (runs[:-1] == SPACE) | (runs[:-1] == LINE)])
    pairs = hash_shingles(words, 2)
    return Stats(
        len(words), counts[DOUBLED[SIGN]], counts[DOUBLED[UPPER]], float((first & (runs == LOWER)).sum()) / n,
        counts[SIGN] + counts[DOUBLED[SIGN]] + counts[BAR], counts[BAR], counts[DOUBLED[CRY]], counts[STOP] + counts[COMMA] + counts[DOUBLED[STOP]],
        float((words[1:] == words[:-1]).sum()) / n, len(np.unique(pairs)) / max(1, len(pairs)),
    )


def _vote(bad: bool, good: bool = False) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


#: The labellers, by name; each sees the figures of a text of at least one word. They overlap: every kind of
#: bad text that one of them knows is also seen, by another sign, by a second.
LABELLERS = {
    "marks": lambda s: _vote(s.marked > 0.25),
    "signs": lambda s: _vote(s.signs > 0.12 and s.words >= 12, s.signs < 0.02),
    "cells": lambda s: _vote(s.cells > 0.15),
    "capitals": lambda s: _vote(s.shouted > 0.5 and s.words >= 4),
    "cries": lambda s: _vote(s.cried > 0.25),
    "lower": lambda s: _vote(s.lower < 0.5 and s.words >= 8, s.lower > 0.75),
    "echo": lambda s: _vote(s.echoed > 0.25 and s.words >= 4),
    "novelty": lambda s: _vote(s.words >= 8 and s.novel < 0.55, s.words >= 8 and s.novel > 0.8),
    "flow": lambda s: _vote(s.words >= 40 and s.stops < 0.01, 0.03 < s.stops < 0.5),
}


def votes_of(text: bytes | None) -> str:
    """One digit per labeller; all abstain on a text without words."""
    if not text or not text.strip():
        return str(ABSTAIN) * len(LABELLERS)
    stats = text_stats(text)
    return "".join(str(f(stats)) for f in LABELLERS.values())


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: roots of the shares of four-grams of byte-class runs, of words, and of repeated words and pairs."""
    if not text or not text.strip():
        return np.empty(0, np.int32), np.empty(0, np.float32)
    runs = np.pad(class_runs(text), (0, 3)).astype(np.uint32)
    grams = (runs[:-3] << np.uint32(12)) | (runs[1:-2] << np.uint32(8)) | (runs[2:-1] << np.uint32(4)) | runs[3:]
    shapes, many = np.unique((grams * np.uint32(2654435761)) >> np.uint32(20), return_counts=True)
    words = hash_words(words_of(text))
    known, often = np.unique(words >> np.uint64(50), return_counts=True)
    pairs = hash_shingles(words, 2)
    repeated = np.array([(words[1:] == words[:-1]).sum() / len(words), 1 - len(np.unique(pairs)) / len(pairs)])
    buckets = np.concatenate([shapes.astype(np.int32), known.astype(np.int32) + SHAPE_BUCKETS, [BUCKETS - 2, BUCKETS - 1]])
    return buckets.astype(np.int32), np.sqrt(np.concatenate([many / len(grams), often / len(words), repeated])).astype(np.float32)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents and, per labeller, the chance of each vote given bad and good."""

    good: float
    chances: np.ndarray

    def posterior(self, votes: str) -> float:
        logs = np.log([1 - self.good, self.good])
        for chance, v in zip(self.chances, votes, strict=True):
            if int(v) != ABSTAIN:
                logs = logs + np.log(chance[:, int(v)])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60))))


def fit_labels(patterns: list[tuple[str, int]], rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over (votes, documents); at most 3 to the labellers' number of patterns.

    The first posteriors are the votes' shares of good, with one vote more on either side. Add-one counts
    keep a labeller that never votes harmless.
    """
    votes = np.array([[int(c) for c in v] for v, _ in patterns], np.int64).reshape(-1, len(LABELLERS))
    weight = np.array([n for _, n in patterns], float)
    good = (1 + (votes == GOOD).sum(axis=1)) / (2 + (votes != ABSTAIN).sum(axis=1))
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        share = np.stack([weight * (1 - good), weight * good])
        chances = np.ones((len(LABELLERS), 2, 3))
        for v in (ABSTAIN, BAD, GOOD):
            chances[:, :, v] += ((votes == v).T[:, None, :] * share[None]).sum(axis=2)
        chances /= chances.sum(axis=2, keepdims=True)
        model = LabelModel(float((share[1].sum() + 1) / (weight.sum() + 2)), chances)
        good = np.array([model.posterior(v) for v, _ in patterns])
    return model


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, the bias last, by AdaGrad over all of (buckets, values, posterior)."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        weights[-1] = 10.0
        return weights
    seen = np.full(BUCKETS + 1, 1e-8)
    at = np.concatenate([np.append(b, BUCKETS) for b, _, _ in rows]).astype(np.int64)
    value = np.concatenate([np.append(v, 1.0) for _, v, _ in rows]).astype(np.float64)
    starts = np.cumsum([0, *(len(b) + 1 for b, _, _ in rows[:-1])])
    lengths = np.array([len(b) + 1 for b, _, _ in rows])
    target = np.array([t for _, _, t in rows])
    for _ in range(rounds):
        z = np.add.reduceat(weights[at] * value, starts)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        grad = np.bincount(at, value * np.repeat(error, lengths), minlength=BUCKETS + 1) + decay / len(rows) * weights
        seen += grad * grad
        weights -= rate * grad / np.sqrt(seen)
    return weights


def score(text: bytes | None, weights: np.ndarray) -> float:
    """Chance that the text is good, 0.0 for one without words."""
    buckets, values = features(text)
    if not len(buckets):
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(weights[buckets] @ values + weights[-1], -30, 30))))


def train(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE, entries: int = ENTRIES) -> tuple[LabelModel, np.ndarray]:
    """The label model of all rows and the scorer fitted on a sample of at most ``sample`` rows.

    Votes are counted in Spark over all documents; the driver gets the counts of vote patterns and the
    sample's features. Rows are sampled by a hash of id and text size, so that the order of rows and
    the partitions don't matter. The sample ends where its features have ``entries`` entries, so that long
    texts don't make it larger than some tens of megabytes; it comes as packed bytes.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 40)))
    total = rows.count()
    limit = (1 << 40) if total <= sample else int((1 << 40) * sample / total)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes, buckets, values = [], [], []
        for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            votes.append(votes_of(text))
            b, v = features(text) if at < limit else (None, None)
            buckets.append(None if b is None else b.tobytes())
            values.append(None if v is None else v.tobytes())
        return pa.record_batch([batch.column(0), pa.array(votes, pa.string()), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], names=["at", "votes", "buckets", "values"])

    voted = checkpointed(arrow_pass(rows.select("at", "text"), run, "at long, votes string, buckets binary, values binary"))
    patterns = sorted((r["votes"], r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect())
    model = fit_labels(patterns)
    posterior = {v: model.posterior(v) for v, _ in patterns}
    order = ("at", "votes", "buckets")
    drawn = voted.where(F.length("buckets") > 0).orderBy(*order).limit(sample)
    upto = F.sum(F.length("buckets") / 4).over(Window.orderBy(*order))
    chosen = drawn.withColumn("upto", upto).where(F.col("upto") <= entries).select("votes", "buckets", "values").toArrow()
    columns = (chosen.column(c).to_pylist() for c in ("votes", "buckets", "values"))
    fitted = fit_scorer([(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32), posterior[p]) for p, b, v in zip(*columns, strict=True)])
    del chosen, columns
    give_back()
    return model, fitted


def classify(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score, keep``: one row per row of ``df``, scored on its whole text.

    A null, empty or blank text scores 0 and isn't kept. Repeated rows get the same score; a null id stays
    null. An empty table gives an empty result. Other columns are ignored.
    """
    _, weights = train(df, id_col, text_col, sample)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = pa.array([score(t, shared.value) for t in batch.column(1).to_pylist()], pa.float64())
        return pa.record_batch([batch.column(0), scores], names=["doc_id", "score"])

    return arrow_pass(rows, run, "doc_id long, score double").withColumn("keep", F.col("score") >= KEEP_AT)


def kept_documents(df: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> DataFrame:
    """``df`` without the rows that the classifier rejects; all columns stay as they are."""
    _, weights = train(df, id_col, text_col, sample)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([score(t, shared.value) >= KEEP_AT for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

    return arrow_pass(df, run, df.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for all ``documents``."""
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return found.withColumn("score", F.round("score", 6))
