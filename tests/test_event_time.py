"""Event time on streams: silent keys are closed, late rows are marked."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import noisy_traffic
from tests.test_streams import START, drain, in_files
from wiretide.operators.framing import walk_frames
from wiretide.streaming.processors import Idle, mark_late, stream_frames, use_rocksdb


@pytest.fixture(autouse=True)
def rocksdb(spark):
    use_rocksdb(spark)


def test_a_silent_capture_is_closed(spark, tmp_path):
    """Capture a stops in the middle of a frame while b goes on: a's tail is decided and its state
    goes, and when a speaks again it starts anew. b, never silent, keeps its tail."""
    a, b = noisy_traffic(random.Random(5), 20, 0.004), noisy_traffic(random.Random(6), 60, 0.004)
    rows, at = [], START
    for part, (name, data, minutes) in enumerate((("a", a[:-3], 0), ("b", b[: len(b) // 2], 1), ("b", b[len(b) // 2 :], 9), ("a", a, 10), ("b", b[:16], 11))):
        at = START + timedelta(minutes=minutes)
        rows += [(name, part * 10_000 + i, at + timedelta(milliseconds=i), bytearray(data[i : i + 16]), part) for i in range(0, len(data), 16)]
    df = spark.createDataFrame(rows, "capture_id string, line int, ts timestamp_ntz, bytes binary, part int")
    live = in_files(spark, df, tmp_path, "idle", 5)
    got = drain(spark, stream_frames(live, order=["line"], idle=Idle("ts", 0, 300_000)), tmp_path, "idle_frames")
    first = walk_frames(df.where("part = 0"), order=["line"]).collect()
    key = lambda r: (r.capture_id, r.off, r.len, r.role)
    closed = [r for r in got if r.role is None]
    assert [(r.capture_id, r.off) for r in closed] == [("a", len(a) - 3)]
    mine = [key(r) for r in got if r.capture_id == "a"]
    again = {key(r) for r in walk_frames(df.where("part = 3"), order=["line"]).collect() if r.role}
    assert {key(r) for r in first} <= set(mine) and len(again - set(mine)) <= 2
    whole = {key(r) for r in walk_frames(df.where("capture_id = 'b'"), order=["line"]).collect() if r.role}
    live_b = {key(r) for r in got if r.capture_id == "b"}
    assert live_b <= whole and len(whole - live_b) <= 2


def test_late_rows_are_marked_per_key(spark, tmp_path):
    seconds = [("a", 100, 0), ("b", 10, 0), ("a", 90, 1), ("a", 94, 1), ("b", 8, 1), ("a", 200, 1), ("a", 120, 2), ("b", 3, 2)]
    df = spark.createDataFrame([(k, START + timedelta(seconds=s), s, p) for k, s, p in seconds], "k string, ts timestamp_ntz, s int, part int")
    live = in_files(spark, df.withColumn("ts", F.col("ts").cast("timestamp")), tmp_path, "late", 3)
    got = drain(spark, mark_late(live, ["k"], "ts", 6_000), tmp_path, "late_rows")
    assert {(r.k, r.s) for r in got if r.late} == {("a", 90), ("a", 120), ("b", 3)} and len(got) == len(seconds)
    assert isinstance(got[0].ts, datetime)
