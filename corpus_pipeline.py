"""Corpus pipeline: filter `documents` by quality, deduplicate, remove benchmark passages, encode.

Each stage takes the documents its predecessor kept and returns them with the columns of `documents`;
the last returns encodings. Between stages the rows are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.llm import chunk_dedup, jaccard_join, pieces, quality_crf, winnowing
from tillwork.llm.common import crc32_fold, materialize
from tillwork.llm.queries import PIECES

LEAST_QUALITY = 0.3


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it learns from four of five labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc32_fold(F.col("doc_id"), 5) != 0)
    model = quality_crf.train(docs, labels)
    scored = quality_crf.score(docs, model, into="_quality")
    return scored.where(F.col("_quality") >= LEAST_QUALITY).select(*docs.columns)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the row with the largest id stays."""
    return chunk_dedup.drop_exact_duplicates(docs)


def ngram_jaccard_join(spark, docs, sf_dir):
    """Of documents linked by similar sets of word 4-grams the one with the smallest id stays."""
    return jaccard_join.keep_one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark, docs, sf_dir):
    """Piece ids of each text (packed int32), their number and score, and the next best segmentations."""
    return pieces.encode(docs, PIECES)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_dedup), ("n-gram Jaccard join", ngram_jaccard_join),
          ("benchmark decontamination", benchmark_decontamination), ("SentencePiece encoding", sentencepiece)]

# SQL can express neither the classifier nor the segmentation; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, "pipeline")
    return docs
