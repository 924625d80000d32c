"""The capture is laid out once: its lines, chunks and frames stay where the exchanges are."""

from datetime import datetime

from pyspark.sql import functions as F

from wiretide.operators import runs
from wiretide.operators.framing import walk_frames
from wiretide.operators.runs import Run, lay_out
from wiretide.plans import table_capture as capture
from wiretide.plans.pipelines import frames_from_lines
from wiretide.sources.hexdump import parse_lines


def lineitem(spark, folder, n=400):
    rows = spark.range(n).select(
        (F.col("id") / 3).cast("long").alias("l_orderkey"), (1 + F.col("id") % 7).alias("l_linenumber"), (F.col("id") * 37 % 200).alias("l_partkey"),
        (F.col("id") * 11 % 9).alias("l_suppkey"), (F.col("id") * 1.5).alias("l_extendedprice"), (40 + F.col("id") % 11).alias("l_quantity"))
    rows.unionAll(rows.where("l_orderkey % 50 = 1")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_lines_and_frames_keep_the_cuts_of_the_exchanges(spark, tmp_path, monkeypatch):
    folder = lineitem(spark, tmp_path)
    columns = ["capture_id", "off", "ts", "role", "device", "fc", "len", "swap", "gap"]
    whole = sorted(map(str, frames_from_lines(capture.log_lines(spark, folder), capture.LINE_KEYS).select(*columns).collect()))
    monkeypatch.setattr(runs, "ROWS_PER_CUT", 80)
    lines = capture.log_lines(spark, folder)
    assert isinstance(lines, Run) and lines.dealt and lines.split and lines.pieces > 8
    plan = parse_lines(lines).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    assert sorted(map(str, frames_from_lines(lines, capture.LINE_KEYS).select(*columns).collect())) == whole


def test_cuts_inside_frames_are_walked_again(spark):
    ask, answer = "0103000000044409", "010308000100020003000494d5"
    data, at = bytes.fromhex((ask + answer + "00") * 40), datetime(2026, 1, 1)
    rows = [("a", i, at, data[i * 5 : i * 5 + 5]) for i in range(-(-len(data) // 5))]
    chunks = spark.createDataFrame(rows, "capture_id string, line int, ts timestamp_ntz, bytes binary")
    whole = sorted(map(str, walk_frames(chunks, order=["line"]).collect()))
    laid = lay_out(chunks, ["capture_id"], ["line"], 7)
    assert laid.split and sorted(map(str, walk_frames(laid, order=["line"]).collect())) == whole


def test_odd_lines_are_judged_part_by_part(spark):
    head = "2026-01-01 00:00:00.000  00000000  "
    good = ["01 02 |..|", "0102 03\t04 |....|", "0A  |.|  ", "0a| | |"]
    bad = ["", "0 10 |..|", "01 0|.|", "01\t|.|", "01 0g |..|", "01 02", "01 02 |", "01 02 |..| x", "|01 02|"]
    lines = spark.createDataFrame([("c", i, v if v is None else head + v) for i, v in enumerate([*good, *bad, None])], "capture_id string, i int, value string")
    got = {r.i: bytes(r.bytes).hex() for r in parse_lines(lines).collect()}
    assert got == {0: "0102", 1: "01020304", 2: "0a", 3: "0a"}
    assert parse_lines(spark.createDataFrame([("c", "2026-01-01 00:00:00.000 0 " + "01 " * 20_000 + "||")], "capture_id string, value string")).count() == 1
