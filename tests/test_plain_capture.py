"""Plain lines are taken apart by place, and CRCs of frames that begin with a chunk are computed together."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.frames import GOLDEN, plain_walk, raw
from wiretide.operators import framing
from wiretide.operators.folds import _segments
from wiretide.sources import hexdump

HEAD = "2026-01-01 00:00:00.000  00000010  "
LINES = [
    HEAD + "01 02 |..|", HEAD + "01 02 " + "   " * 14 + "|..|", HEAD + "0A |a|b|", HEAD + "0a  |\n|", HEAD + " ".join(["ff"] * 16) + " |é|",
    HEAD + " ".join(["FE"] * 17) + " |.|", HEAD + "01 02 |..|  ", HEAD + "01 02|..|", HEAD + "01 02 |", HEAD + "01 02 |..", HEAD + "01  02 |..|", HEAD + "|..|", HEAD + "01 0 |..|",
    HEAD.replace("01-01", "02-30") + "01 |.|", HEAD.replace("00:00:00", "24:00:00") + "01 |.|", HEAD.replace("00000010", "100000010") + "01 |.|", HEAD.replace("-", "/") + "01 |.|", "", None,
]


def test_plain_lines_are_not_split_and_give_the_same(spark, monkeypatch):
    lines = spark.createDataFrame([("c", i, v) for i, v in enumerate(LINES)], "capture_id string, i int, value string")
    plain = {r.i for r in lines.where(F.col("value").endswith("|") & F.col("value").rlike(hexdump.PLAIN)).collect()}
    assert plain == {0, 1, 2, 3, 4, 13, 14}
    columns = ["i", F.col("ts").cast("string").alias("ts"), "offset", F.hex("bytes").alias("bytes")]
    got = sorted(hexdump.parse_lines(lines).select(*columns).collect())
    assert {r.i for r in got} == {0, 1, 2, 3, 4, 5, 6, 7, 10, 15}
    assert got[0].bytes == "0102" and got[0].offset == 16 and got[2].bytes == "0A" and got[4].bytes == "FF" * 16
    monkeypatch.setattr(hexdump, "PLAIN", r"\A\z.")  # every line goes the general way
    assert sorted(hexdump.parse_lines(lines).select(*columns).collect()) == got


def test_crcs_of_chunks_are_computed_together(monkeypatch):
    one_by_one, single = [], framing.crc16_bytes
    monkeypatch.setattr(framing, "crc16_bytes", lambda data: (one_by_one.append(data), single(data))[1])
    frames = [raw(f) for f in GOLDEN] * 40
    chunks = [f[i : i + 16] for f in frames for i in range(0, len(f), 16)]
    out, _ = framing.FrameWalk().feed(framing.FrameWalk().start(), pd.DataFrame({"us": range(len(chunks)), "bytes": chunks}), 0)
    assert list(zip(out["off"], out["len"], out["role"], out["swap"])) == plain_walk(b"".join(frames))[0]
    assert len(one_by_one) < len(frames) / 10


@pytest.mark.parametrize("kind", [pa.string(), pa.int64(), pa.float64()])
def test_segments_treat_nulls_as_one_key(kind):
    cells = {pa.string(): ["a", "a", None, None, "b"], pa.int64(): [1, 1, None, None, 2], pa.float64(): [1.0, 1.0, None, None, 2.0]}[kind]
    found = list(_segments(pa.table({"k": pa.array(cells, kind), "v": range(5)}), ["k"]))
    assert [(key, rows["v"].tolist()) for key, rows in found] == [((cells[0],), [0, 1]), ((None,), [2, 3]), ((cells[4],), [4])]
