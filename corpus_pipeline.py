"""A corpus pipeline: from documents to packed training sequences, in five stages that are written and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import decontamination, near_dedup, packing, quality_classifier, suffix_dedup
from crashlens.llm.common import ship, stored, table
from crashlens.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely of the lowest grade than of a higher one. The ratings are of documents of the corpus,
    so the model is fitted on these."""
    ship(spark)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.select(docs, model)


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, that of smallest id."""
    ship(spark)
    return near_dedup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 50-byte strings that start in a document of smaller id; ``n_chars`` follows the text."""
    ship(spark)
    left = suffix_dedup.clean(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with whatever values in its slots."""
    ship(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left, each sequence with the corpus' proportions of sources."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("near-duplicates", different_documents),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("packing", sequences),
]

#: Neither the fitted model nor the samples of the second stage can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
