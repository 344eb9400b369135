"""A training-data pipeline over documents: quality, near duplicates, benchmark items, personal data, mix of sources.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs. run() writes what a stage keeps as Parquet to the
shared checkpoint folder and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glasspane.llm import common as C
from glasspane.llm import contamination, mixing, neardup, pii, quality
from glasspane.llm import queries as Q


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labelled ones, scores 0.5 or more. Every third document (by id) is held out."""
    net = quality.train(docs, Q.read(spark, sf_dir, "labels"), C.fold("doc_id", 3) == 1)
    return quality.accepted(docs, net)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.without(docs, Q.read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix of sources."""
    return mixing.mix(docs, Q.TARGETS, Q.REST_WEIGHT)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("mix", mixed),
]

ORACLE_SQL = None  # a trained network, MinHash and learned patterns are beyond SQL; tests/llm compares with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, in the order of the mix by mix_position."""
    docs = Q.read(spark, sf_dir, "documents")
    folder = f"{C.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
