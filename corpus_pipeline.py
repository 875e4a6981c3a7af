"""A training-data pipeline over the documents table: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm._tables import discard_since, stash, stashed
from loomspark.llm.decontam import decontaminate
from loomspark.llm.lang_id import keep_identified
from loomspark.llm.mixing import mixture, positions
from loomspark.llm.sharding import assign
from loomspark.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, of no likely language, or of n-grams foreign to the likeliest one."""
    return keep_identified(docs, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of linked fingerprints, also among rows without ids."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised or not."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order in which source blocks fall due by their target weights, file after file."""
    return mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``position``, each document's number in the order of the mixture, its ``shard``, and the length of the shard's hash prefix.

    Reading a shard by position gives its part of the mixture in the mixture's order.
    """
    return assign(positions(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Neither a fitted classifier nor connected components of fingerprints can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        mark = stashed()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = stash(docs, name)
            discard_since(mark, path)
    return docs
