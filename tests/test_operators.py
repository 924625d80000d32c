import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wiretide.functions.scalar import first_in_roots, register_column
from wiretide.operators import changes, dims, stats, telemetry, throttle
from wiretide.operators.asof import asof_join, join_streams
from wiretide.operators.redact import redact_hex, redact_text
from wiretide.operators.registers import Spec, match_specs, parse_spec
from wiretide.operators.runs import run
from wiretide.sinks import files
from wiretide.sources.ndjson import POLL_FIELDS, read_poll_keys, read_polls, read_tags, rejected_records

START = datetime(2026, 5, 2, 10)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, times repeat, values have gaps."""
    rnd = random.Random(4)
    rows = [
        (None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.7 else rnd.choice("abc"), i, START + timedelta(seconds=rnd.randint(0, 900)),
         rnd.choice([None, 1, 2, 3, 4]))
        for i in range(900)
    ]
    return spark.createDataFrame(rows, "key string, seq int, ts timestamp, v int").cache()


@pytest.mark.parametrize("keys", [["key"], []])
def test_cut_runs_equal_plain_windows(skewed, keys):
    order = ["ts", "seq"]
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "seq", F.last("v", ignorenulls=True).over(upto).alias("known"), F.lag("v").over(w).alias("before"),
        F.lead("v").over(w).alias("after"), F.sum("v").over(upto).alias("sum"), F.sum("v").over(Window.partitionBy(*keys)).alias("all"),
    )
    cut = run(skewed, keys, order, rows_per_cut=60)
    assert cut.split
    v = F.col("v")
    got = cut.last_known({"known": v}).lag({"before": v}).lead({"after": v}).running_sum({"sum": v}).total({"all": v}).done()
    got = got.select(want.columns)
    assert sorted(got.collect()) == sorted(want.collect())


def brute_gap(rows, gap, dedupe):
    kept, last = [], {}
    for r in sorted(rows, key=lambda r: (str(r.key), r.ts, r.seq)):
        if r.key in last:
            value, ts = last[r.key]
            if (dedupe and r.v == value) or (r.ts - ts).total_seconds() < gap:
                continue
        last[r.key] = (r.v, r.ts)
        kept.append(r.seq)
    return sorted(kept)


@pytest.mark.parametrize("rows_per_cut", [None, 100])
@pytest.mark.parametrize("gap", [0, 20])
def test_throttling_equals_brute_force(skewed, gap, rows_per_cut):
    rows = skewed.collect()
    kept = throttle.min_gap(skewed, ["key"], ["ts", "seq"], "ts", ["v"], gap, rows_per_cut)
    assert sorted(r.seq for r in kept.collect()) == brute_gap(rows, gap, True)
    if gap:
        kept = throttle.rate_limit(skewed, ["key"], ["ts", "seq"], "ts", gap, rows_per_cut)
        assert sorted(r.seq for r in kept.collect()) == brute_gap(rows, gap, False)


def test_quantiles_of_a_hot_key(skewed):
    want = skewed.groupBy("key").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.95)).alias("b"))
    got = stats.quantiles(skewed, ["key"], "v", {"a": 0.5, "b": 0.95}, rows_per_cut=2)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_asof_fill_tags_and_empty_sides(spark):
    wire = spark.createDataFrame([(at(i), 4, i) for i in (1, 2, 3)], "ts timestamp, fc int, fld_x int")
    polls = spark.createDataFrame([(at(0), 50), (at(2), 51)], "ts timestamp, tcp_soc int")
    tags = spark.createDataFrame([(at(0), "idle", "manual"), (at(3), "force_charge_start", "manual")], "ts timestamp, tag string, source string")
    rows = join_streams(wire, polls, tags).orderBy("ts").collect()
    assert [r.tcp_soc for r in rows] == [50, 51, 51]
    assert [r.active_tag for r in rows] == ["idle", "idle", "force_charge_start"]
    bare = join_streams(wire, None, None)
    assert bare.count() == 3 and bare.where("active_tag is null").count() == 3 and "tcp_soc" not in bare.columns
    none = join_streams(wire.limit(0), polls, tags)
    assert none.count() == 0 and "tcp_soc" in none.columns


def test_asof_matches_whole_rows(spark):
    wire = spark.createDataFrame([(at(5),)], "ts timestamp")
    polls = spark.createDataFrame([(at(0), 1, 1, 0), (at(2), 5, 7, 1), (at(2), None, 8, 2)], "ts timestamp, a int, b int, seq int")
    row = asof_join(wire, polls, right_columns=["a", "b"], right_seq="seq").collect()[0]
    assert (row.a, row.b) == (None, 8)
    late = asof_join(wire, polls, right_columns=["b"], right_seq="seq", tolerance_seconds=2).collect()[0]
    assert late.b is None


def test_asof_hot_key_equals_brute_force(skewed):
    left, right = skewed.where("seq % 2 = 0"), skewed.where("seq % 2 = 1").withColumnRenamed("v", "rv").withColumnRenamed("seq", "rseq")
    got = asof_join(left, right, by=["key"], right_columns=["rv", "rseq"], left_seq="seq", right_seq="rseq", rows_per_cut=50)
    rights = right.collect()
    for r in got.collect():
        best = max((q for q in rights if r.key is not None and q.key == r.key and q.ts <= r.ts), key=lambda q: (q.ts, q.rseq), default=None)
        assert (r.rv, r.rseq) == ((best.rv, best.rseq) if best else (None, None))


def test_changes_skip_missing(spark):
    modes = ["idle", "idle", None, "charge", "charge", "idle"]
    df = spark.createDataFrame([(i, at(i), m) for i, m in enumerate(modes)], "seq int, ts timestamp, mode string").withColumn("k", F.lit(1))
    found = changes.changes(df, ["k"], ["seq"], "mode").orderBy("seq").collect()
    assert [(r.prev_value, r.new_value) for r in found] == [("idle", "charge"), ("charge", "idle")]
    tags = changes.auto_tags(df, ["k"], ["seq"], "mode").orderBy("ts").collect()
    assert (tags[0].tag, tags[0].source) == ("auto:mode:idle->charge", "auto")


def test_coincidences_equal_brute_force(spark, skewed):
    flips = changes.bit_transitions(skewed, ["key"], ["ts", "seq"], "v", bits=3)
    reported = changes.changes(skewed, ["key"], ["ts", "seq"], "v")
    got = changes.coincidences(flips, reported, ["key"], 30, bits=3, rows_per_cut=200)
    a, b = flips.where("key is not null").collect(), reported.where("key is not null").collect()
    a += flips.where("key is null").collect()
    b += reported.where("key is null").collect()
    want = {}
    for x in a:
        for y in b:
            if x.key == y.key and abs((x.ts - y.ts).total_seconds()) <= 30:
                want[(x.bit, y.prev_value, y.new_value)] = want.get((x.bit, y.prev_value, y.new_value), 0) + 1
    assert {(r.bit, r.prev_value, r.new_value): r.n for r in got.collect()} == want


def test_specs(spark):
    assert parse_spec("w@1:3:0x28+1") == Spec("w", 1, 3, 0x28, 1)
    assert parse_spec("*:0x04:*") == Spec("w", None, 4, None, 0)
    for bad in ("x@1:3:4", "1:3", "1:b:3", "1:3:4+-1", "1:3:+1", "1:3:4+"):
        with pytest.raises(ValueError):
            parse_spec(bad)
    keys = spark.createDataFrame([(1, 3, 40), (1, 3, 41), (1, 3, 43)], "device int, fc int, reg int")
    found = match_specs(keys, [parse_spec("*:*:*+1")]).collect()
    assert [(r.reg, r.byte_offset) for r in found] == [(40, 1)]  # the others straddle unknown registers
    assert register_column(1, 3, 40, 1) == "device_001_fc_03_reg_00040_byte_001"


def test_overrides(spark):
    regs = spark.createDataFrame([(1, 3, 5, 10), (1, 3, 6, 20)], "device int, fc int, reg int, value int")
    edits = spark.createDataFrame(
        [(1, 3, 5, 1, 99), (1, 3, 6, 2, 7), (1, 3, 6, 3, None)], "device int, fc int, reg int, edit_seq int, value int"
    )
    for few in (100, 0):
        rows = dims.apply_overrides(regs, dims.settle_overrides(edits), broadcast_rows=few).orderBy("reg").collect()
        assert [(r.value, r.changed) for r in rows] == [(99, True), (20, False)]


def test_dimensions():
    assert dims.PACK_ALARM_BITS[0] == "cell_overvoltage" and dims.PACK_ALARM_BITS[7] == "discharge_overtemp"
    assert dims.PACK_STATUS_BITS[2] == "charging"


def test_redaction(spark):
    def clean(text, serials=(), ips=()):
        return spark.range(1).select(redact_text(F.lit(text), serials, ips)).collect()[0][0]

    text = "serial AB12 at 10.0.0.1, hex 41 42 31 32 and 41 42 31 32, not 10.0.0.12 or 110.0.0.1"
    once = clean(text, ["AB12"], ["10.0.0.1"])
    assert once == "serial XXXX at X.X.X.X, hex XX XX XX XX and XX XX XX XX, not 10.0.0.12 or 110.0.0.1"
    assert clean(once, ["AB12"], ["10.0.0.1"]) == once
    assert clean("at 10.0.0.1.", (), ["10.0.0.1"]) == "at X.X.X.X."
    assert clean("4a 4b 4c", ["JKL"]) == "XX XX XX" and clean(text) == text
    data = bytes([1, 2, 0x41, 0x42, 0x43, 3, 4])
    row = spark.createDataFrame([(bytearray(data),)], "d binary").select(redact_hex(F.col("d"), ["ABC"])).collect()[0][0]
    assert bytes(row) == bytes([1, 2, 0x58, 0x58, 0x58, 3, 4])
    split = spark.createDataFrame([(bytearray([0x14, 0x14]),)], "d binary").select(redact_hex(F.col("d"), ["A"])).collect()[0][0]
    assert bytes(split) == bytes([0x14, 0x14])  # 41 lies across two bytes


def test_ndjson_sources(spark, tmp_path):
    polls, tags = tmp_path / "p.ndjson", tmp_path / "t.ndjson"
    polls.write_text("\n".join([
        json.dumps({"ts": "2026-05-02T10:00:00.123456+01:00", "fields": {"soc": 50, "status": "Normal", "odd": {"a": 1}}}),
        "", "not json", json.dumps({"ts": "2026-05-02T10:00:01+00:00", "fields": {"soc": "n/a"}})]))
    tags.write_text("\n".join([json.dumps({"ts": "2026-05-02T10:00:00+00:00", "tag": "idle"}), "[1", json.dumps({"ts": "2026-05-02T10:00:04+00:00", "tag": "x", "source": "auto"})]))
    rows = read_polls(spark, str(polls)).orderBy("ts").collect()
    assert [(r.tcp_soc, r.tcp_status) for r in rows] == [(50.0, "Normal"), (None, None)]
    assert rows[0].ts == datetime(2026, 5, 2, 9, 0, 0, 123456)
    assert len(POLL_FIELDS) == 31
    assert {r.field for r in read_poll_keys(spark, str(polls)).collect()} == {"soc", "status", "odd"}
    assert [(r.tag, r.source) for r in read_tags(spark, str(tags)).orderBy("ts").collect()] == [("idle", "manual"), ("x", "auto")]
    assert rejected_records(spark, str(polls)).collect()[0].rejected == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, at(1), 1, 3, 23, 65534), ("a", 2, at(2), 1, 3, 23, None)],
                               "capture_id string, pair_off int, ts timestamp, device int, fc int, reg int, value int")
    files.write_state_csv(df, str(tmp_path / "csv"), ["value"])
    text = next((tmp_path / "csv" / "capture_id=a").glob("*.csv")).read_text().splitlines()
    assert text == ["timestamp,value", "2026-05-02 10:00:01.000000,65534", "2026-05-02 10:00:02.000000,"]
    files.write_joined(df, str(tmp_path / "joined"))
    assert spark.read.parquet(str(tmp_path / "joined")).where("capture_id = 'a'").count() == 2
    row = files.register_log_rows(df.limit(1)).collect()[0]
    assert (row.register, row.value_hex, row.value_signed) == ("holding:23", "0xFFFE", -2)
    assert files.register_log_text(df.limit(1)).collect()[0].value == "2026-05-02 10:00:01.000 device=1 holding[23]=0xFFFE (65534)"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.log").write_text("keep\nSN1 here\n")
    (tmp_path / "in" / "blob.bin").write_bytes(b"\x00SN1\x01")
    files.redact_text_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["SN1"])
    parts = sorted((tmp_path / "out" / "file=note.log").glob("*.txt"))
    assert "".join(p.read_text() for p in parts) == "keep\nXXX here\n"
    blob = files.redact_binary_files(spark, str(tmp_path / "in"), ["SN1"]).collect()
    assert [bytes(r.content) for r in blob] == [b"\x00XXX\x01"]
    files.write_ndjson(df, str(tmp_path / "nd"))
    files.write_ndjson(df, str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 4


def test_telemetry(spark):
    row = spark.createDataFrame([(53125, -1400, 18600, 93, [3316, 3324, 3310, 3324])],
                                "pack_voltage_mV int, pack_current_mA int, total_cap_cAh int, soc_pct int, cells array<int>")
    out = telemetry.other_protocol_units(row, F.col("cells")).collect()[0]
    assert (out.BatteryVoltage, out.BatteryCurrent, out.RatedCapacity, out.SoC) == (5312.5, -14.0, 1860.0, 93)
    assert (out.MinCellVoltage, out.MinCellId, out.MaxCellVoltage, out.MaxCellId) == (3310, 3, 3324, 2)
    wire = spark.createDataFrame([("a", 1, 0, at(0), 5, None), ("a", 2, 1, at(1), 7, 40), ("a", 1, 2, at(2), None, 30)],
                                 "capture_id string, device int, pair_off int, ts timestamp, cur int, soc int")
    held = telemetry.pack_readings(wire, ["capture_id"], ["pair_off"], ["cur", "soc"])
    stack = telemetry.multi_pack(held, ["capture_id"], "ts", "1 minute", order=F.col("pair_off"), total=["cur"], lowest=["soc"]).collect()[0]
    assert (stack.packs, stack.cur, stack.soc) == (2, 12, 30)


def test_first_value_over_nested_roots(spark):
    schema = "inverter struct<x int, y int>, batteries array<struct<x int, y int>>, plant struct<x int, y int>"
    df = spark.createDataFrame([((None, 1), [(None, 2), (7, 3)], (9, 4)), ((None, None), [], (9, 4))], schema)
    rows = df.select(first_in_roots("x", "inverter", "batteries", "plant"), first_in_roots("y", "inverter", "batteries", "plant")).collect()
    assert [tuple(r) for r in rows] == [(7, 1), (9, 4)]
