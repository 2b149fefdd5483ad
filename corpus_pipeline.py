"""From raw documents to packed training batches: each stage calls one operator of ``tidegauge.llm``.

Each stage works on all rows that it gets, by whole texts; columns of any name beside ``doc_id``, ``text`` and
``source`` are carried and never read. An empty table goes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import exact_dedup, mixing, packing, quality_rules, simhash
from tidegauge.llm.common import documents, labels, written


#: Rows of whole texts that go to a Python worker at a time. The workers of an executor are used again by all stages and keep the memory that
#: they once took, so the largest batch of any stage counts in all later ones.
BATCH = 1_000


def in_small_batches(stage: Callable) -> Callable:
    """``stage`` with Arrow batches of BATCH rows or fewer, also where its result is written after it returned."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(size)) <= BATCH:
            spark.conf.set(size, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go.

    Null, empty and short texts fail the base rules. Null ids are judged like others; repeated rows get one verdict.
    """
    return quality_rules.passing(docs, quality_rules.fit(docs, labels(spark, sf_dir)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one with the largest doc_id stays.

    A null text equals an empty one. A null id is smaller than any other; of rows with one id and text one stays.
    """
    return exact_dedup.without_copies(docs)


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a 5-word Jaccard similarity of 0.8 or more, the row with the smallest doc_id stays.

    A null id stays only where all are null; of equal ids the first by file and row. Texts without words are one group.
    """
    return simhash.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: rows are left out or repeated, in training order.

    A null source is a source; rows without words are left out where their source's target is reached. Ties stand in
    the order of a hash of the id.
    """
    return mixing.curriculum(docs)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their texts, dealt to buckets and batches in the training order that the mix wrote them in.

    Null and empty texts have one piece of length 0; very long ones have as many pieces as they need. Repeated rows are packed
    each, in batches of their own as far as a bucket has several.
    """
    return packing.packed(packing.stored_order(docs), order=("_block", "_at"))


STAGES = [
    ("quality_rules", rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned rules, and similarity with connected components, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result of each is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
