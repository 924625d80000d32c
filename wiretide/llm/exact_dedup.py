"""Exact duplicates: heavy hitters removed on the map side, the rest by an ordinary shuffle.

DataFrame functions only. A frequent-items sketch (of the Misra-Gries family: counters that are
decremented together when they run out, merged over tasks) proposes at most ``heavy`` digests and
finds each one that holds more than about 1/``heavy`` of the rows. What it proposes is verified by
exact counts, and the winner of each proposed group is broadcast, so rows of hot groups never
shuffle. What is left has no group above that share and is grouped by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.shared import stored, text_of

SPACES = r"[\x20\x09-\x0D]"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, counters: int = 8192) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they agree after white space (space, 0x09-0x0D) is deleted. The row with
    the most code points in the original text stays, then the one of the smallest id. NULL texts
    are empty texts, and all texts without other characters are one group. Rows that share id and
    text are told apart by nothing, so they share ``kept``; a NULL id comes after all others. Other
    columns of ``docs``, whatever their names, are not read. An empty table gives no rows.
    """
    text = text_of(text_col)
    digests = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(text).alias("__length"),
            F.sha2(F.regexp_replace(text, SPACES, ""), 256).alias("text_sha256"),
        ),
        "digests",
    )
    best = F.min(F.struct((-F.col("__length")).alias("shortness"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("keep_id")))
    summed = [best.alias("__best"), F.count("*").alias("__rows")]
    frequent = digests.select(F.explode(F.expr(f"approx_top_k(text_sha256, {heavy}, {counters})")).alias("item")).select(F.col("item.item").alias("text_sha256"))
    verified = stored(digests.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*summed), "winners")
    marked = digests.join(F.broadcast(verified), "text_sha256", "left")
    hot = marked.where(F.col("__rows").isNotNull())
    rest = marked.where(F.col("__rows").isNull()).drop("__best", "__rows")
    cold = rest.join(rest.groupBy("text_sha256").agg(*summed), "text_sha256")
    keep = F.col("__best.keep_id")
    return hot.unionByName(cold).select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("__rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
