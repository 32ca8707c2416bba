"""The corpus pipeline: documents through the stages of STAGES, each written and read again.

Every stage takes the session, the documents that its predecessor kept and the folder of the tables,
and returns a DataFrame; all but the last return the columns of ``documents``. No stage depends on what
another computed: the classifier is fitted, copies are grouped and texts are searched on its own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm.decontaminate import without_items
from plotline.llm.ngram_join import similar_groups
from plotline.llm.piece_sampling import encode
from plotline.llm.quality_classifier import kept_documents
from plotline.llm.secret_scan import redact
from plotline.operators.checkpoints import ensure_checkpoint_dir, remove_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return kept_documents(docs, "doc_id", "text")


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id, of several such rows one.

    Every row is a document of its own, under a number that is written with it; null ids come last.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/numbered-{uuid.uuid4()}"
    number = f"row_{uuid.uuid4().hex}"
    docs.withColumn(number, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    numbered = spark.read.parquet(folder)
    groups = similar_groups(numbered, number, "text").select(F.col("doc_id").alias(number), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", number)
    kept = groups.join(numbered.select(number, "doc_id"), number).groupBy("component_id").agg(F.min(order)[number].alias(number))
    return numbered.join(kept.select(number), number, "left_semi").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_items(docs, "text", items, "item_id", "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind in brackets; n_chars follows."""
    masked = redact(docs, "text")
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoding of every document, whether it decodes to the text, and sampled segmentations."""
    return encode(docs, "doc_id", "text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: SQL can't express the classifier, the sampling and the token-efficiency test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written to the shared folder and read again.

    A result goes once its successor is written; that of the last stage but one stays, as the returned
    rows are computed from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove_folder(spark, f"{folder}/{i - 1}")
    return docs
