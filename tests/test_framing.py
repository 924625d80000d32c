import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.frames import ABSENT_IR1, GOLDEN, HR_RESPONSE, IR1_RESPONSE, crc, noisy_traffic, plain_walk, raw
from wiretide.functions.binary import crc16, crc16_bytes, crc16_native, valid_crc
from wiretide.operators.decode import decode_pairs, register_rows, wire_table
from wiretide.operators.framing import frames_only, walk_frames
from wiretide.operators.layouts import EXTENDED, STANDARD
from wiretide.operators.pairing import pair_frames, pair_latest, pair_pending
from wiretide.operators.redact import redact_frames
from wiretide.operators.registers import field_columns, parse_spec, register_state
from wiretide.operators.telemetry import absent_block
from wiretide.plans import report
from wiretide.plans.pipelines import capture_report, register_state_table, wire_from_logs
from wiretide.sources.hexdump import (
    format_hexdump,
    parse_lines,
    read_hexdump,
    rejected_lines,
    scan_lines,
    with_session,
)

START = datetime(2026, 5, 1, 7, 23, 39)


def chunk_rows(capture, data, size=16):
    return [
        (capture, i, START + timedelta(milliseconds=i), bytearray(data[i * size : (i + 1) * size]))
        for i in range(-(-len(data) // size))
    ]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "capture_id string, line int, ts timestamp_ntz, bytes binary")


def walk(spark, streams, rows_per_cut=None):
    rows = [r for name, data in streams.items() for r in chunk_rows(name, data)]
    return walk_frames(chunks(spark, rows), order=["line"], rows_per_cut=rows_per_cut)


def golden_pairs(spark, **kwargs):
    frames = frames_only(walk(spark, {"a": b"".join(map(raw, GOLDEN))}))
    return pair_frames(frames, **kwargs)


def test_crc_forms_agree(spark):
    frames = [raw(f) for f in GOLDEN] + [b"", b"\x01"]
    df = spark.createDataFrame([(bytearray(f),) for f in frames], "raw binary")
    for row in df.select("raw", crc16("raw").alias("a"), crc16_native("raw").alias("b")).collect():
        want = int.from_bytes(crc(bytes(row.raw)), "little")
        assert row.a == row.b == crc16_bytes(bytes(row.raw)) == want
    assert df.where(valid_crc("raw")).count() == len(GOLDEN)


def test_walk_equals_plain_walk_whole_and_cut(spark):
    rnd = random.Random(11)
    streams = {f"c{e}": noisy_traffic(rnd, 250, e) for e in (0.0, 0.002, 0.02)}
    for rows_per_cut in (None, 150):
        walked = walk(spark, streams, rows_per_cut).collect()
        for name, data in streams.items():
            mine = sorted((r for r in walked if r.capture_id == name), key=lambda r: (r.off, r.role is None))
            want, drops = plain_walk(data)
            assert [(r.off, r.len, r.role, r.swap) for r in mine if r.role] == want
            assert sum(r.gap for r in mine) == drops
            for r in mine:
                if r.role:
                    assert bytes(r.raw) == data[r.off : r.off + r.len]
                    assert r.ts == START + timedelta(milliseconds=r.off // 16)


def test_frame_times_do_not_depend_on_the_session_zone(spark):
    """Naive log times survive zones with summer time, repeated hour included."""
    rows = [("a", i, datetime(2026, m, d, 1, 30), bytearray(raw(GOLDEN[0]))) for i, (m, d) in enumerate([(1, 5), (3, 29), (7, 1), (10, 25)])]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        got = frames_only(walk_frames(chunks(spark, rows), order=["line"])).orderBy("off").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.ts for r in got] == [r[2] for r in rows]


def test_golden_decode(spark):
    rows = wire_table(golden_pairs(spark), fields=STANDARD + EXTENDED).orderBy("pair_off").collect()
    hr, ir1, ir2, ir3, write = rows
    assert (hr.hr11_soc_x100, hr.hr17_dynamic, hr.hr19_status) == (186, 4427, 207)
    assert (hr.hr23_pack_current_cA, hr.hr25_current_limit) == (-14, 9000)
    assert ir1.serial == "SN00000001" + " " * 10
    assert [ir1[f"temp_{i}_decidegC"] for i in range(5)] == [171, 178, 173, 165, 169]
    assert (ir2.cell_count, ir2.cycle_count, ir2.pack_voltage_mV, ir2.soc_pct, ir2.fw_version) == (16, 737, 53125, 93, 3022)
    assert (ir2.total_cap_cAh, ir2.design_cap_cAh, ir2.remain_cap_cAh) == (19392, 18600, 18043)
    assert (ir2.pack_current_mA, ir2.total_cap_wide_cAh) == (-203, 19392)
    cells = [ir3[f"cell_{i}_mV"] for i in range(16)]
    assert cells == [3316, 3317, 3317] + [3319] * 4 + [3320] * 3 + [3322] * 5 + [3324]
    assert (ir3.max_cell_mV, ir3.min_cell_mV) == (max(cells), min(cells))
    assert (ir3.block3_b32_offset, ir3.block3_b34_offset) == (2909, 2895)
    assert write.fc == 6 and write["count"] is None and write.serial is None and hr.serial is None


def test_pairing_kinds(spark):
    assert golden_pairs(spark).count() == 5
    with_exceptions = golden_pairs(spark, exceptions=True)
    assert with_exceptions.where("rsp_fc = 131").count() == 1
    assert register_rows(with_exceptions).count() == 28 + 21 + 19 + 20 + 1
    frames = frames_only(walk(spark, {"a": b"".join(map(raw, GOLDEN))}))
    for paired in (pair_pending(frames), pair_latest(frames)):
        assert sorted(r["count"] for r in paired.collect()) == [19, 20, 21, 28]


def test_pending_queue_takes_late_answers_and_forgets_the_oldest(spark):
    ask = [("a", i, START, "request", 1, 3, 8, bytearray(raw("01 03 00 00 00 01 84 0A"))) for i in range(40)]
    answer = [("a", 100 + i, START, "response", 1, 3, 7, bytearray(7)) for i in range(40)]
    frames = spark.createDataFrame(
        ask + answer, "capture_id string, off bigint, ts timestamp_ntz, role string, device int, fc int, len int, raw binary"
    )
    for rows_per_cut in (None, 9):
        found = sorted((r.rsp_off, r.req_off) for r in pair_pending(frames, rows_per_cut=rows_per_cut).collect())
        assert found == [(100 + i, 8 + i) for i in range(32)]
    assert [(r.req_off, r.rsp_off) for r in pair_latest(frames).collect()] == [(39, 100)]


def test_report_sections(spark):
    walked = walk(spark, {"a": b"\x00\x00" + b"".join(map(raw, GOLDEN))})
    sections = report.report(walked, pair_frames(frames_only(walked)))
    totals = sections["totals"].collect()[0]
    assert (totals.frames, totals.drops, totals.pairs) == (12, 2, 5)
    assert {(r.role, r.fc): r.n for r in sections["frame_summary"].collect()}[("request", 4)] == 3
    assert sections["writes"].collect()[0].addr == 0xE7
    assert sections["exceptions"].collect()[0].code == 1
    assert sections["latency"].where("rank = 1").count() == 1
    assert sections["cadence"].where("requests = 1 and avg_ms is null").count() == 4


def test_log_files_round_trip(spark, tmp_path):
    data = b"".join(map(raw, GOLDEN)) * 3
    flushes = spark.createDataFrame(
        [("cap", i, START + timedelta(milliseconds=100 * i), bytearray(data[i * 40 : (i + 1) * 40])) for i in range(-(-len(data) // 40))],
        "capture_id string, flush int, ts timestamp_ntz, bytes binary",
    )
    lines = [r.value for r in format_hexdump(flushes, ["flush"]).orderBy("flush", "piece").collect()]
    assert lines[0] == "2026-05-01 07:23:39.000  00000000  01 03 00 00 00 1C 44 03 01 03 38 00 65 FF FF FF  |......D...8.e...|"
    log = tmp_path / "cap.log"
    log.write_text("\n".join(["# noise", lines[0].replace("01 03", "XX XX"), *lines, ""]))
    chunked = read_hexdump(spark, str(log))
    assert b"".join(bytes(r.bytes) for r in chunked.orderBy("path", "block", "line").collect()) == data
    assert rejected_lines(scan_lines(spark, str(log))).collect()[0].rejected == 2
    assert capture_report(spark, str(log))["totals"].collect()[0].pairs == 15
    state, names = register_state_table(spark, str(log), ["w@1:3:0x0b", "sw@1:3:23", "b@1:6:*"])
    assert names[0] == "device_001_fc_03_reg_00011" and len(names) == 18
    first = state.orderBy("pair_off").collect()
    assert first[0][names[0]] == 186 and first[0][names[1]] == -14 and first[0][names[2]] is None
    assert len(first) == 2  # nothing changes after the first write
    wire = wire_from_logs(spark, str(log), wire_tz="Europe/London")
    assert wire.agg(F.min("ts")).collect()[0][0] == datetime(2026, 5, 1, 6, 23, 39)


def test_offset_restart_starts_a_session(spark):
    rows = [("c", i, off) for i, off in enumerate([0, 16, 32, 0, 16])]
    df = spark.createDataFrame(rows, "capture_id string, line int, offset bigint")
    assert [r.session_id for r in with_session(df, ["line"]).orderBy("line").collect()] == [0, 0, 0, 1, 1]


def test_split_word_state(spark):
    data = bytes([1, 3, 0, 0x28, 0, 2]), bytes([1, 3, 4, 0x11, 0x22, 0x33, 0x44])
    stream = b"".join(p + crc(p) for p in data)
    pairs = pair_frames(frames_only(walk(spark, {"a": stream})), exceptions=True)
    columns = field_columns(register_rows(pairs), [parse_spec("w@1:3:0x28+1")])
    assert [c.name for c in columns] == ["device_001_fc_03_reg_00040_byte_001"]
    assert register_state(pairs, columns).collect()[0][columns[0].name] == 0x2233


def test_absent_and_strict_start(spark):
    df = spark.createDataFrame([(bytearray(raw(ABSENT_IR1)[4:-2]),), (bytearray(raw(IR1_RESPONSE)[4:-2]),)], "d binary")
    assert [r[0] for r in df.select(absent_block(F.col("d"), "IR1")).collect()] == [True, False]
    moved = golden_pairs(spark).where("fc = 3").withColumn("addr", F.lit(5))
    assert decode_pairs(moved).collect()[0].hr11_soc_x100 == 186
    assert decode_pairs(moved, strict_start=True).collect()[0].hr11_soc_x100 is None


def test_redacted_frames_stay_valid(spark):
    df = spark.createDataFrame([(bytearray(raw(f)),) for f in (HR_RESPONSE, IR1_RESPONSE)], "raw binary")
    hidden = redact_frames(df, ["SN00000001"])
    assert hidden.where(valid_crc("raw")).count() == 2
    assert all(b"XXXXXXXXXX" in bytes(r.raw) for r in hidden.collect())
    assert redact_frames(hidden, ["SN00000001"]).collect() == hidden.collect()
