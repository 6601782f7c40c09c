"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import Scratch, table
from tidemark.llm.decontaminate import drop_contained
from tidemark.llm.jaccard import jaccard_groups
from tidemark.llm.pieces import encode_pieces
from tidemark.llm.secrets import redact, scan_secrets

#: Documents whose probability of good quality is below this go.
LEAST_QUALITY = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, gives an even chance of good quality or more.

    Null and empty texts are scored as texts without tokens, rows that repeat stay or go together, and without labels
    every score is a half, so that all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, name="_quality").filter(F.col("_quality") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity join, the one with the smallest id stays; rows of one id stay together, and so do
    rows without id or words."""
    groups = jaccard_groups(docs)
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; those without words stay."""
    return drop_contained(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars follows."""
    clean = scan_secrets(docs).withColumn("text", redact(F.col("text"), F.col("secret_spans")))
    return clean.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the ids of its pieces; a null or empty text has none."""
    return encode_pieces(docs, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", as_pieces),
]

#: Learned scores and graph components are beyond SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
