"""Quantiles of a group whose values take several cuts."""

from statistics import median

from pyspark.sql import functions as F

from wiretide.operators import runs
from wiretide.plans.catalog import latency_by_type


def test_latency_by_type_with_cut_groups(spark, tmp_path, monkeypatch):
    kind = F.element_at(F.lit(["click", "purchase", "click", "error"]), (1 + F.col("id") % 4).cast("int"))
    rows = spark.range(1200).select(
        F.col("id").alias("event_id"), F.floor(F.col("id") / 20).alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"),
        F.timestamp_millis(F.col("id") * 1000 + F.col("id") * F.col("id") % 977).alias("ts"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(runs, "ROWS_PER_CUT", 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")  # more than cuts: another plan
    try:
        got = {r.rsp_type: r for r in latency_by_type(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for first, name in ((0, "purchase"), (2, "error")):
        gaps = [1000 + (i + 1) ** 2 % 977 - i * i % 977 for i in range(first, 1200, 4)]
        assert (got[name].n, got[name].p50) == (len(gaps), median(gaps))
