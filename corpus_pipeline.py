"""Corpus pipeline: five stages, each over all rows that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next documents, the last
one the token digests.  Between stages rows are written as Parquet to the shared folder and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changewright.llm.common import cut, table
from changewright.llm.decontaminate import decontaminate
from changewright.llm.language_id import language_filter
from changewright.llm.line_dedup import line_dedup
from changewright.llm.queries import token_digests
from changewright.llm.simhash import simhash_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; others go."""
    return language_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated three-line windows are cut out; documents that lose every line go."""
    return line_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one of least id."""
    return simhash_dedup(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of what is left, decoded again."""
    return token_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("decontaminate", benchmarks),
    ("byte_bpe", tokens),
]

#: Training, components and merges are no SQL; tests/llm compares a small run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
