"""The corpus pipeline: quality, exact duplicates, near-duplicates, mixture and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each result to the
cluster's shared folder as Parquet and reads it again, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from notemill.llm import exact_dedup, minhash, mixing, packing, quality
from notemill.llm.common import ensure_checkpoint_dir, read, remove, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers do not reject."""
    return quality.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their targets: documents once, twice or not at all."""
    return mixing.mix_documents(docs, share=1.5, weights=mixing.WEIGHTS, passes=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in their sequences; a document that the mix holds twice is packed twice."""
    ship(spark)
    return packing.pack_documents(docs, "word_bpe_49k.json", 2048, 0)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Classifier and signatures are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of sf_dir. What a stage was given goes when its result is written."""
    shared = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
        if k:
            remove(spark, f"{shared}/{k - 1}")
    return docs
