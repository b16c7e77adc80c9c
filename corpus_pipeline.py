"""A corpus pipeline of five stages, each of them one operator of ``triago.llm``.

A stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and its decisions take effect: what it
rejects is gone for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triago.llm import language, mixing, quality, segment, simhash
from triago.llm.common import shared_dir, table


#: Rows in a batch for a Python worker. Whole texts are large, and an executor holds batches of several workers.
BATCH_ROWS = 2000
#: Characters whose lattices a worker holds at once, beside what earlier stages left in the executor.
BATCH_CHARS = 300_000


def small_batches(stage: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage under a session that sends Python workers at most BATCH_ROWS rows at once. A batch's size changes no
    result; the setting stays for the session, as the stage's rows are made when they are written."""

    @functools.wraps(stage)
    def under(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.set(name, str(min(BATCH_ROWS, int(spark.conf.get(name)))))
        return stage(spark, docs, sf_dir)

    return under


@small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is uncertain, go."""
    return language.identified_documents(docs)


@small_batches
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Groups are the components of the SimHash
    index; pairs at a Jaccard similarity that fingerprints are too far apart for join them."""
    return simhash.one_of_each(docs, linked=simhash.linked_nodes)


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


@small_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document: two rows each, with the ids of their pieces."""
    return segment.sampled(docs, batch_chars=BATCH_CHARS)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
#: The classifiers, the near-duplicate stage and the piece sampler are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again by the next."""
    root, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
