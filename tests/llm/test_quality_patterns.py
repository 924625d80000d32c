"""Votes of the held-out fold count in the label model."""

import zlib

from pyspark.sql import functions as F

from wiretide.llm import quality


def test_patterns_of_the_held_out_fold_count(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "%%% $$$ " * 20 if k % 3 == 0 else "The plain words of this text say what they mean and then they end. " * 5) for k, i in enumerate(held)]
    found = quality.score_quality(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found.where("not held_out or weak_label = 0.5").count() == 0
    assert found.where(F.col("score") != 0.5).count() == len(rows)
