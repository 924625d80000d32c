"""Register intervals of laid out captures: found inside the cuts, joined only at their edges."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from wiretide.functions.binary import words
from wiretide.operators.registers import state_intervals
from wiretide.operators.runs import lay_out

START = datetime(2026, 1, 1)


def plain(rows):
    held = {}
    for capture, device, fc, reg, value, at in sorted(rows, key=lambda r: r[-1]):
        seen = held.setdefault((capture, device, fc, reg), [])
        if not seen or seen[-1][0] != value:
            if seen:
                seen[-1][2] = at
            seen.append([value, at, None])
    return {(*key, *i) for key, seen in held.items() for i in seen}


def test_intervals_cross_any_number_of_cuts(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, 2]), 3, rnd.choice([0, 1, 1, 1, 7]), rnd.choice([0, 0, 0, 0, 5, None]), i) for i in range(900)]
    rows += [("a", 1, 3, 99, 4, 900 + i) for i in range(60)] + [("a", 1, 3, 0, 1, 990)]  # one value over whole cuts
    df = spark.createDataFrame([(*r, START + timedelta(seconds=r[-1])) for r in rows],
                               "capture_id string, device int, fc int, reg int, value int, pair_off long, ts timestamp_ntz")
    for size in (40, 300):
        laid = lay_out(df, ["capture_id"], ["pair_off"], size)
        assert laid.split
        found = state_intervals(laid)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and found.columns[-4:] == ["from_ts", "from_pair_off", "to_ts", "to_pair_off"]
        got = found.collect()
        assert {(r.capture_id, r.device, r.fc, r.reg, r.value, r.from_pair_off, r.to_pair_off) for r in got} == plain(rows)
        assert len(got) == len(plain(rows))
        for r in got:
            assert r.from_ts == START + timedelta(seconds=r.from_pair_off)
            assert r.to_ts == (None if r.to_pair_off is None else START + timedelta(seconds=r.to_pair_off))


def test_blocks_of_registers_give_the_same_intervals(spark):
    rnd = random.Random(8)
    blocks = [(rnd.choice(["a", "a", "b"]), 1, 3, rnd.choice([0, 2]), [rnd.choice([0, 0, 0, 9, None]) for _ in range(rnd.choice([0, 1, 3, 3]))], i) for i in range(400)]
    rows = [(c, d, f, addr + n, value, at) for c, d, f, addr, values, at in blocks for n, value in enumerate(values)]
    df = spark.createDataFrame([(*b, START + timedelta(seconds=b[-1])) for b in blocks],
                               "capture_id string, device int, fc int, addr int, values array<int>, pair_off long, ts timestamp_ntz")
    for size in (25, 10_000):  # cut, whole
        laid = lay_out(df, ["capture_id"], ["pair_off"], size)
        assert laid.split == (size == 25)
        if laid.split:
            plan = state_intervals(laid)._jdf.queryExecution().executedPlan().toString()
            assert "Generate posexplode" not in plan
        got = state_intervals(laid).collect()
        assert sorted(map(str, plain(rows))) == sorted(str((r.capture_id, r.device, r.fc, r.reg, r.value, r.from_pair_off, r.to_pair_off)) for r in got)


def test_laid_out_rows_are_not_sorted_again(spark):
    rows = [("a", i, START, bytes([i % 256])) for i in range(90)]
    laid = lay_out(spark.createDataFrame(rows, "capture_id string, line int, ts timestamp_ntz, bytes binary"), ["capture_id"], ["line"], 30)
    assert laid.sorted and laid.running_sum({"n": F.lit(1)}).sorted
    assert not laid.within("ts").running_sum({"n": F.lit(1)}).sorted


def test_words_of_a_batch():
    data = pa.array([b"\x01\x02\xff\xfe", None, b"", b"\x00", b"\x80\x00\x07"])
    assert words.func(data).to_pylist() == [[258, 65534], None, [], [], [32768]]
    assert words.func(data[3:]).to_pylist() == [[], [32768]]
