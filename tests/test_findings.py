"""Cases that once gave wrong answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wiretide.functions.scalar import duration_ms, micros
from wiretide.operators.asof import asof_join
from wiretide.operators.telemetry import other_protocol_units
from wiretide.sources.hexdump import parse_lines, rejected_lines, scan_lines

LINE = "2026-05-01 07:23:39.416  00000000  01 03 00 00 00 1C 44 03                          |......D.|"


@pytest.fixture
def new_york(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_files_of_one_name_are_two_captures(spark, tmp_path):
    for site in "ab":
        (tmp_path / site).mkdir()
        (tmp_path / site / "wire.log").write_text(LINE + "\n")
    lines = scan_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert lines.select("capture_id").distinct().count() == 2


def test_good_and_bad_lines(spark):
    bad = ["", "# note", LINE.replace("01 03", "XX 03"), LINE.replace("01 03", "1 03"), LINE[:-1], LINE.replace("2026-05-01", "2026-15-01"), LINE.replace("00000000", "zz"), LINE.split("|")[0], "2026-05-01 07:23:39.416  00000000  |..|"]
    good = [LINE, LINE + "  ", LINE.replace("01 03 00", "010300"), LINE.replace("......D.", "..|..|D."), LINE.replace("1C", "1c")]
    lines = spark.createDataFrame([("c", v) for v in bad + good], "capture_id string, value string")
    rows = parse_lines(lines).collect()
    assert [bytes(r.bytes).hex() for r in rows] == ["01030000001c4403"] * len(good)
    assert rows[0].ts == datetime(2026, 5, 1, 7, 23, 39, 416000)
    assert rejected_lines(lines).first().rejected == len(bad)


def test_null_keys_match_nothing(spark):
    at = datetime(2026, 1, 1)
    left = spark.createDataFrame([(None, at, 1), ("k", at, 2)], "k string, ts timestamp_ntz, x int")
    right = spark.createDataFrame([(None, at, 7), ("k", at, 8)], "k string, ts timestamp_ntz, y int")
    assert {r.x: r.y for r in asof_join(left, right, by=["k"]).collect()} == {1: None, 2: 8}


def test_naive_durations_ignore_the_zone(new_york):
    row = new_york.createDataFrame([(datetime(2026, 3, 8, 1, 59, 59), datetime(2026, 3, 8, 2, 0, 1))], "a timestamp_ntz, b timestamp_ntz")
    kind = row.schema["a"].dataType
    found = row.select(duration_ms(F.col("a"), F.col("b")).alias("ms"), (micros(F.col("b"), kind) - micros(F.col("a"), kind)).alias("us")).first()
    assert (found.ms, found.us) == (2000.0, 2_000_000)


def test_current_of_decoded_tables(spark):
    row = spark.createDataFrame([(-14, [3316, 3324])], "hr23_pack_current_cA int, cells array<int>")
    assert other_protocol_units(row, F.col("cells")).first().BatteryCurrent == -1.4


def test_default_cuts_split_a_hot_key(spark):
    from pyspark.sql import functions as F

    from wiretide.operators.runs import CUT, ROWS_PER_CUT, run

    n = 4 * ROWS_PER_CUT
    rows = spark.range(n).select(F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("k"), F.lit("same").alias("path"), "id")
    cut = run(rows, ["k"], ["path", "id"])
    sizes = {tuple(r[:2]): r["count"] for r in cut.df.groupBy("k", CUT).count().collect()}
    assert sizes[("cold", None)] == n // 50
    assert len(sizes) >= 4 and max(sizes.values()) < 2 * ROWS_PER_CUT
    last = cut.running_sum({"n": F.lit(1)}).done().groupBy("k").agg(F.max("n").alias("n"), F.count_distinct("n").alias("d"))
    assert {r["k"]: (r["n"], r["d"]) for r in last.collect()} == {"cold": (n // 50,) * 2, "hot": (n - n // 50,) * 2}
