"""A pipeline over ``documents``: rules, near duplicates, decontamination, personal data, packing.

Every stage takes rows with null or empty texts, null or repeated ids, very long
texts and further columns as its operator's docstring says, and an empty table
gives an empty result of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ohmgrid.llm import decontamination, jaccard_join, packing, pii, quality_rules
from ohmgrid.llm.common import forget, table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and the outlier rule keep; null and empty texts fail the base rules."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group whose word 5-shingle sets link at a Jaccard similarity of 0.8; null ids stay."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no passage of ``benchmark``, null texts among them."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced; a null text stays null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and its place there; a null text is one end token."""
    return packing.best_fit(packing.pieces(docs.select("doc_id", "text"), **packing.vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: SQL expresses neither the robust outliers nor the span classifier.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        done = written(made, name)
        forget(made, docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
