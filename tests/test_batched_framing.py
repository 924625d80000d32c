"""Lines are printed and taken apart in batches, exchanges are framed together, cuts are walked again once."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tests.frames import GOLDEN, crc, noisy_traffic, plain_walk, raw
from wiretide.operators import folds, framing
from wiretide.operators.framing import walk_frames
from wiretide.operators.runs import lay_out
from wiretide.sources import hexdump

HEAD = "2026-01-01 00:00:00.000  00000010  "


def feed(chunks, step=None):
    step = step or framing.FrameWalk()
    return step.feed(step.start(), pd.DataFrame({"us": range(len(chunks)), "bytes": chunks}), 0)[0]


def found(out):
    return list(zip(out["off"], out["len"], out["role"], out["swap"]))


def test_clean_exchanges_take_no_steps_of_their_own(monkeypatch):
    steps, size = [], framing.FrameWalk._size
    monkeypatch.setattr(framing.FrameWalk, "_size", lambda self, *a: (steps.append(1), size(self, *a))[1])
    frames = [raw(f) for f in GOLDEN] * 40
    out = feed([f[i : i + 16] for f in frames for i in range(0, len(f), 16)])
    assert found(out) == plain_walk(b"".join(frames))[0] and not steps


def test_exchanges_between_noise_and_lost_answers_are_found():
    rnd = random.Random(5)
    for errors in (0, 0.001, 0.01):
        data = noisy_traffic(rnd, 60, errors)
        starts = sorted({off for off, *_ in plain_walk(data)[0]} | {0, len(data)})
        chunks = [data[a:b] for a, b in zip(starts, starts[1:])]
        want = [f for f in plain_walk(data)[0] if f[0] + f[1] < len(data) - 70]
        assert found(feed(chunks))[: len(want)] == want


def test_plain_lines_are_taken_apart_in_batches(spark):
    times = ["2024-02-29 23:59:59.999", "2023-02-29 00:00:00.000", "2000-02-29 12:00:00.001", "1900-02-29 12:00:00.000", "1969-12-31 23:59:59.123", "2026-13-01 00:00:00.000"]
    lines = [f"{t}  00ABcdef  0A ff |..|" for t in times] + [HEAD + v for v in ("01 |||", "01 " * 16 + "|.|", "01 02 |é|", "01  02 |.|", "01 0", "|", "01 |", "01 x |.|")] + [None, ""]
    rows = hexdump._by_place.func(pa.array(lines)).to_pylist()
    assert [r is not None for r in rows] == [True, False, True, False, True, False, True, True, True, False, False, False, False, False, False, False]
    assert rows[0] == {"ts": datetime(2024, 2, 29, 23, 59, 59, 999000), "offset": 0x00ABCDEF, "bytes": b"\x0a\xff"}
    assert rows[4]["ts"] == datetime(1969, 12, 31, 23, 59, 59, 123000) and rows[7]["bytes"] == b"\x01" * 16
    df = spark.createDataFrame([("c", v) for v in lines], "capture_id string, value string")
    got = {(r.ts, r.offset, bytes(r.bytes)) for r in hexdump.parse_lines(df).collect()}
    assert {tuple(r.values()) for r in rows if r} | {(datetime(2026, 1, 1), 16, b"\x01\x02")} == got


def test_lines_are_printed_in_batches(spark):
    sizes = [1, 15, 16, 17, 61, 0, 256]
    rows = [("c", i, None if i == 3 else datetime(2026, 1, 1) + timedelta(milliseconds=i), bytes((i + j) % 256 for j in range(n))) for i, n in enumerate(sizes)]
    printed = hexdump.format_hexdump(spark.createDataFrame(rows, "capture_id string, i int, ts timestamp_ntz, bytes binary"), ["i"])
    want, start = [], 0
    for _, i, ts, data in rows:
        for at in range(0, len(data), 16):
            part = data[at : at + 16]
            text = "".join(chr(c) if 32 <= c < 127 else "." for c in part)
            want.append((i, at, ts and f"{ts:%Y-%m-%d %H:%M:%S}.{ts.microsecond // 1000:03}  {start + at:08x}  {part.hex(' ').upper():<48} |{text}|"))
        start += len(data)
    assert [(r.i, r.piece, r.value) for r in printed.orderBy("i", "piece").collect()] == want
    far = hexdump._lines.func(pa.array(["t", "t"]), pa.array([2**32 - 16, 15]), pa.array([b"a" * 17, b"b"])).to_pylist()
    assert [line[3 : line.index("  ", 3)] for part in far for line in part] == ["fffffff0", "100000000", "0000000f"]


def test_cuts_are_walked_again_once(spark, monkeypatch):
    walks, walker = [], folds._walker
    monkeypatch.setattr(folds, "_walker", lambda *a: (walks.append(a[-2:]), walker(*a))[1])
    ask, answer = bytes([1, 3, 0, 0, 0, 4]), bytes([1, 3, 8, 0, 1, 0, 2, 0, 3, 0, 4])
    data = (ask + crc(ask) + answer + crc(answer)) * 40
    rows = [("a", i, datetime(2026, 1, 1), data[i * 5 : i * 5 + 5]) for i in range(-(-len(data) // 5))]
    chunks = spark.createDataFrame(rows, "capture_id string, line int, ts timestamp_ntz, bytes binary")
    whole = sorted(map(str, walk_frames(chunks, order=["line"]).collect()))
    walks.clear()
    laid = lay_out(chunks, ["capture_id"], ["line"], 22)
    assert laid.split and sorted(map(str, walk_frames(laid, order=["line"]).collect())) == whole
    assert walks == [(True, True)] * 2
    assert walk_frames(laid, order=["line"]).where(F.col("role") == "response").count() == 40
