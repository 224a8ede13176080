"""Corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from launchlens.llm import jaccard, packing, quality_model, quality_rules, queries
from launchlens.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go; null and empty texts are among them."""
    rules = quality_rules.fit(docs, queries.table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules, COLUMNS).where("kept").select("_keys.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, by the decision of its operator, go; the model learns from the documents at hand."""
    model = quality_model.fit(docs, queries.table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, COLUMNS).where(F.col("score") >= quality_model.ACCEPT_FROM).select("_keys.*")


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Texts without words are no copies of each other and stay, of rows that repeat a doc_id one. A row without
    doc_id stays only if no document of its group has one, and then one of them.
    """
    return jaccard.one_per_group(docs, COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text in pieces, each with its bucket, batch and slot."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("jaccard_join", join_stage),
    ("packing", packing_stage),
]
#: The learned stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each kept in the shared folder before the next."""
    docs = queries.table(spark, sf_dir, "documents").select(*COLUMNS)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut_lineage(docs)
    return docs
