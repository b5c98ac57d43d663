"""Training-data pipeline: quality, exact copies, near copies, mix, packing.

Each stage takes what its predecessor kept, written as Parquet, and returns a
table with the columns of ``documents``; the last returns packed pieces.
Columns besides ``doc_id, text, source`` are carried through the first four
stages, whatever their names. An empty table stays empty in every stage, and
texts are treated whole, however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import exact_dedup, jaccard, mixing, packing, quality_rules, registry
from pairloom.llm.storage import freed_shuffles, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule lets through. A null or empty text is too short; rows that repeat get equal verdicts; a null id changes nothing."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id. Rows that repeat it become one; a null id loses to any other; null counts as the empty text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id. Rows with a null id and texts without words stay, as they link with nothing; of rows that repeat a kept id all stay."""
    return jaccard.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so one may appear twice; a null source is a source, and a text without words is in none of the shards."""
    return mixing.Mix(docs).documents()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, repeated ones as often as they are there; a null or empty text is its end id alone."""
    return packing.pack(docs, registry.tokenizer_path())


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: Neither the similarity join nor packing has a SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder. A query's shuffle files are freed at its end."""
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with freed_shuffles(spark):
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
    return docs
