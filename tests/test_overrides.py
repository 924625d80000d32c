"""Overrides inside frames, and copies of mixed folders."""

import random

from pyspark.sql import functions as F

from tests.frames import HR_RESPONSE, IR1_RESPONSE, crc, raw
from wiretide.operators.overrides import override_frames
from wiretide.sinks.files import redact_files


def test_patched_frames_have_the_crc_of_a_new_pass(spark):
    rng = random.Random(2)
    wanted, rows, edits = {}, [], {}
    for device, fc, start, count, frame in ((1, 3, 0, 28, raw(HR_RESPONSE)), (1, 4, 0, 21, raw(IR1_RESPONSE)), (2, 3, 0, 28, None)):
        for reg in rng.sample(range(start, start + count + 9), 12):
            edits[device, fc, reg] = rng.randrange(65536)
        if frame is None:
            body = bytes([2, 3, 56]) + bytes(rng.randrange(256) for _ in range(56))
            frame = body + crc(body)
        body, head, changed = bytearray(frame[:-2]), 3 if fc == 3 else 4, 0
        for (d, f, reg), value in edits.items():
            at = head + 2 * (reg - start)
            if (d, f) == (device, fc) and start <= reg < start + count:
                changed += body[at : at + 2] != value.to_bytes(2, "big")
                body[at : at + 2] = value.to_bytes(2, "big")
        wanted[device, fc] = (bytes(body) + crc(body), changed)
        rows.append((device, fc, fc, bytearray(8), bytearray(frame), start, count))
    rows.append((1, 3, 131, bytearray(8), bytearray(b"\x01\x83\x02\xc0\xf1"), 0, 28))  # an exception stays
    rows.append((9, 3, 3, bytearray(8), bytearray(raw(HR_RESPONSE)), 0, 28))  # nothing overridden
    pairs = spark.createDataFrame(rows, "device int, fc int, rsp_fc int, req_raw binary, rsp_raw binary, addr int, count int")
    table = spark.createDataFrame([(*k, v) for k, v in edits.items()], "device int, fc int, reg int, override int")
    found = override_frames(pairs, table).collect()
    assert len(found) == 5
    for r in found:
        if r.rsp_fc == 131 or r.device == 9:
            assert r.overridden == 0 and bytes(r.rsp_raw) in (b"\x01\x83\x02\xc0\xf1", raw(HR_RESPONSE))
        else:
            assert (bytes(r.rsp_raw), r.overridden) == wanted[r.device, r.fc]
    assert override_frames(pairs, table.where(F.lit(False))).where("overridden > 0").count() == 0


def test_a_mixed_folder_is_copied_whole(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("SN1 at 10.0.0.1\n")
    (folder / "b.bin").write_bytes(b"\x00SN1\xff")
    (folder / "c.json").write_text("{}\n")
    redact_files(spark, str(folder), str(tmp_path / "out"), ["SN1"], ["10.0.0.1"])
    text = spark.read.text(str(tmp_path / "out/text")).collect()
    assert sorted((r.file, r.value) for r in text) == [("a.log", "XXX at X.X.X.X"), ("c.json", "{}")]
    assert [bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out/binary")).collect()] == [b"\x00XXX\xff"]
