"""The training-corpus pipeline: quality, exact copies, near copies, benchmark leaks, then tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of ``documents``; the last one replaces the text by its token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.byte_bpe import encode_decode
from quillon.llm.common import fresh, written
from quillon.llm.decontaminate import decontaminate
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.jaccard_join import keep_one
from quillon.llm.quality_cnn import score_quality, train

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, rejects go."""
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = fresh(docs, "score", "predicted")
    return score_quality(docs, network, names=(score, predicted)).filter(F.col(predicted) == 1).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    keep_id, size, kept = fresh(docs, "keep_id", "group_size", "kept")
    return exact_dedup(docs, names=(keep_id, size, kept)).filter(F.col(kept)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) in place of the text, with digests of ids and of what they decode to."""
    coded = encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=True, decoded=False, digests=True)
    return coded.drop("text")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the classifier nor the forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number}")
    return docs
