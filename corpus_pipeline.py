"""Documents to token ids: toxicity, quality, near-duplicates, decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluoroframe.llm import decontaminate, quality, sentencepiece_fst, simhash, toxicity
from fluoroframe.llm.common import table
from fluoroframe.llm.queries import tokenizer_file
from fluoroframe.plans.cut import shared_folder

#: Bytes of texts that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.3, by a lexicon learned from the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of 0.5 or more, by a model fitted on the labelled ones among them."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id."""
    return simhash.keep_one(docs, least=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or with other parameters."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    found = sentencepiece_fst.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "ids", F.crc32("ids").alias("ids_crc32"), "same")


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session whose Arrow batches end at ``BATCH_BYTES``: by default a batch of 10,000 texts has any size,
    which both the executor and its Python workers hold beside the heap."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", bounded(drop_toxic)),
    ("quality", bounded(drop_low_quality)),
    ("simhash", bounded(drop_near_duplicates)),
    ("decontamination", bounded(drop_benchmark_leaks)),
    ("sentencepiece", bounded(encode)),
]

# A learned lexicon, fitted quality scores and piece paths are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
