"""A corpus prepared for training: stages over ``documents``, each an operator of ``wiretide.llm``.

A stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's input. All but the last return the columns of ``docs``. Columns that a stage doesn't need may
have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.decontamination import decontaminate
from wiretide.llm.language import learned, of_a_language
from wiretide.llm.mixing import mixed_rows
from wiretide.llm.near_dedup import keep_one
from wiretide.llm.sharding import assign_shards, numbered
from wiretide.llm.shared import shielded, stored

SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is text of no language: NULL texts, texts without a letter, and texts in which the
    network, learned from the labelled ones, sees no language more than another. Where no document
    is labelled nothing can be learned, and only the first two go."""
    return shielded(docs, ["doc_id", "text", "lang"], lambda rows: of_a_language(rows, learned(rows)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 80 percent)."""
    return shielded(docs, ["doc_id", "text"], lambda rows: keep_one(rows, shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth of the words or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return shielded(docs, ["doc_id", "text"], lambda rows: decontaminate(rows, benchmark, remove="documents"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target words."""
    return shielded(docs, ["doc_id", "text", "source"], lambda rows: mixed_rows(rows, F.array(F.col("source").cast("string"))))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's shard and its slot there."""

    def place(rows: DataFrame) -> DataFrame:
        return numbered(assign_shards(rows, [1.0] * SHARDS).drop("grown_shard"), ["doc_id", "text"])

    return shielded(docs, ["doc_id", "text"], place)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained recurrent network has no SQL; tests compare the other stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        docs = found if name == STAGES[-1][0] else stored(found, f"stage-{name}")
    return docs
