"""Polls and tags of equal time: the later one in the file counts."""

from pyspark.sql import functions as F

from wiretide.plans.pipelines import joined_table
from wiretide.sources.ndjson import read_polls, read_tags


def test_equal_times_are_ordered_by_the_file(spark, tmp_path):
    line = '{"ts": "2026-05-01T00:00:%02d+00:00", "fields": {"soc": %d}, "tag": "t%d", "source": "auto"}'
    (tmp_path / "p.ndjson").write_text("\n".join(line % (i // 50, i, i) for i in range(200)) + "\n")
    wire = spark.range(4).select(F.col("id").alias("pair_off"), F.timestamp_seconds(F.lit(1777593600) + F.col("id")).alias("ts"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        polls, tags = (read(spark, str(tmp_path), seq="n") for read in (read_polls, read_tags))
        assert polls.rdd.getNumPartitions() > 3
        order = [r.tcp_soc for r in polls.orderBy("n").select("tcp_soc").collect()]
        assert order == [float(i) for i in range(200)]
        found = joined_table(wire, polls.repartition(5), tags.repartition(7), [], {"wire": "pair_off", "polls": "n", "tags": "n"})
        rows = sorted((r.pair_off, r.tcp_soc, r.active_tag) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(i, 50.0 * i + 49, f"t{50 * i + 49}") for i in range(4)]
