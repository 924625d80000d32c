"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every record draws one number per shard from its key; the largest weighted draw wins. A new shard
can only win records for itself, so growing from n to n + 1 shards moves about 1 / (n + 1) of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.shared import text_of

#: Rows of one numbering bucket of a shard; the number of buckets follows the table.
BUCKET_ROWS = 20_000


def draw(key: Column, shard: int, weight: float) -> Column:
    """A shard's score for a key: ``-weight / ln(u)`` with ``u`` uniform from their hash."""
    hashed = F.xxhash64(key, F.lit(shard))
    uniform = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.lit(float(weight)) / F.ln(uniform)


def owner(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Equal scores go to the smaller shard; weights must be above zero."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above zero")
    scores = [F.struct(draw(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", grown_weight: float | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard``, its shard once a shard of ``grown_weight`` (by
    default the mean weight) is added. Only the key and the weights decide. Rows of one key, NULL
    included, share a shard. Existing columns of those two names are replaced."""
    more = sum(weights) / len(weights) if grown_weight is None else grown_weight
    key = F.col(id_col)
    return docs.withColumns({"shard": owner(key, weights), "grown_shard": owner(key, [*weights, more])})


def numbered(rows: DataFrame, order: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``slot``: gapless numbers from 0 within each shard.

    Shards are cut into buckets by a hash of ``order``; buckets are counted, then rows are numbered
    within their bucket from where the buckets before end. No task holds a whole shard. ``order``
    must settle every difference between rows that matters; equal rows may swap numbers.
    """
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    cut = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("shard", "__bucket").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__bucket").orderBy(*order)
    return (
        cut.withColumn("__nth", F.row_number().over(within))
        .join(offsets, ["shard", "__bucket"])
        .withColumn("slot", (F.col("__before") + F.col("__nth") - 1).cast("long"))
        .select(*[c for c in rows.columns if c != "slot"], "slot")
    )


def shard_plan(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Size is the text's UTF-8 bytes plus 8. A NULL text has no bytes and the checksum of none. Rows
    with equal ids share a shard and get slots of their own; ids that are NULL form one key. An
    empty table gives no rows; further columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign_shards(rows, [1.0] * shards)
    return numbered(placed, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
