"""Helpers of the operators that concern the session: shared storage, sizes, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.storage import shared_folder


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage: a lost
    executor costs no earlier stage. The caller of a job owns and clears that folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def shielded(docs: DataFrame, needed: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of ``docs``, whatever the other columns are called: all but the ``needed``
    ones go through it under plain names and get their own back. A column that ``work`` adds comes
    before one of that name, which is then called ``doc_<name>``."""
    names = {c: f"x{i}" for i, c in enumerate(docs.columns) if c not in needed}
    out = work(docs.withColumnsRenamed(names))
    added = [c for c in out.columns if c not in needed and c not in names.values()]
    own = [F.col(names.get(c, c)).alias(c if c not in added else f"doc_{c}") for c in docs.columns]
    return out.select(*own, *added)
