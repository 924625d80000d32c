"""One layout of cuts for chains of ordered steps, and throttles that are summed up."""

import json
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wiretide.operators import changes, folds, runs, throttle
from wiretide.operators.pairing import pair_run
from wiretide.operators.registers import FieldColumn, pivot_state, register_state, state_intervals
from wiretide.operators.runs import lay_out, rows_of, run
from wiretide.plans import catalog, report

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def small_cuts(monkeypatch):
    monkeypatch.setattr(runs, "ROWS_PER_CUT", 500)


def jobs(spark, work):
    """What ``work`` returns, and the jobs it ran."""
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = work()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


@pytest.fixture
def frames(spark, small_cuts, monkeypatch):
    monkeypatch.setattr(catalog, "_FRAMED", {})
    return catalog.frames(spark, SMALL)


def test_frames_keep_the_cuts_of_their_log(frames):
    assert frames.split and frames.order == ("off",)
    placed = frames.df.where("__cut IS NOT NULL").groupBy("capture_id", "__cut").agg(F.min("off").alias("low"), F.max("off").alias("high"))
    rows = sorted(map(tuple, placed.collect()))
    assert len(rows) > 5
    for a, b in zip(rows, rows[1:]):
        assert a[0] != b[0] or a[3] < b[2]


def test_a_chain_counts_and_samples_once(spark, frames, monkeypatch):
    """From frames to state rows: no further count, sample or cut, and one stored table a step."""
    cut, written, made = [], [], runs.checkpointed_as_dealt
    monkeypatch.setattr(runs, "split_points", lambda *a: cut.append(a) or {})
    monkeypatch.setattr(runs, "checkpointed_as_dealt", lambda df: written.append(df) or made(df))
    columns = [FieldColumn(1, 3, 11, 0, "w"), FieldColumn(2, 3, 23, 0, "sw")]
    state, while_building = jobs(spark, lambda: register_state(pair_run(frames, exceptions=True), columns))
    # pairs and held values are stored; a stored table takes a job for each shuffle and broadcast
    assert not cut and len(written) == 2 and while_building <= 12
    found = sorted(map(tuple, state.collect()))
    monkeypatch.undo()
    plain = register_state(pair_run(frames.done(), exceptions=True, rows_per_cut=10**9), columns, rows_per_cut=10**9)
    assert found == sorted(map(tuple, plain.collect())) and len(found) > 100


def test_queries_within_captures_share_the_cuts(frames):
    one = report.cadence(pair_run(frames))
    two = report.cadence(pair_run(frames.done(), rows_per_cut=10**9), rows_per_cut=10**9)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    one = report.unanswered(frames, at_least=1)
    two = report.unanswered(frames.done(), at_least=1, rows_per_cut=10**9)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_no_shuffle_after_the_layout(spark, small_cuts):
    rows = spark.range(5000).selectExpr("id % 2 AS k", "id AS at", "id * 7 % 13 AS v")
    laid = lay_out(rows, ["k"], ["at"])
    plan = laid.lag({"before": F.col("v")}).df._jdf.queryExecution().executedPlan().toString()
    main = plan.split("BroadcastExchange")[0]
    assert laid.split and "Exchange hashpartitioning" not in main
    finer = laid.within("v").lag({"before": F.col("at")}).done()
    assert sorted(map(tuple, finer.collect())) == sorted(map(tuple, run(rows, ["k", "v"], ["at"], 10**9).lag({"before": F.col("at")}).done().collect()))


def test_chained_steps_equal_unsplit_ones(spark, small_cuts):
    rng = random.Random(1)
    data = [(i % 3, i, rng.choice([None, 1, 2, 3]), rng.random() < 0.5) for i in range(4000)]
    rows = spark.createDataFrame(data, "k int, at int, v int, odd boolean")

    def chain(start):
        held = start.last_known({"held": F.col("v")}).where(F.col("odd")).select("k", "at", "held")
        return held.lag({"was": F.col("held")}).running_sum({"sum": F.col("was")}).total({"all": F.col("held")}).done()

    assert sorted(map(str, chain(run(rows, ["k"], ["at"])).collect())) == sorted(map(str, chain(run(rows, ["k"], ["at"], 10**9)).collect()))


def _state_after(step, state, rows):
    return step.feed(state, rows, 0)[1]


times = st.lists(st.integers(0, 12), min_size=1, max_size=60)


@settings(max_examples=400, deadline=None)
@given(times, st.lists(st.integers(0, 2), min_size=60, max_size=60), st.integers(1, 25), st.booleans(), st.one_of(st.none(), st.tuples(st.integers(0, 2), st.integers(0, 40))))
def test_a_summed_up_cut_is_the_walked_cut(steps, values, gap, dedupe, entry):
    at = pd.Series(steps).cumsum() + 40
    rows = pd.DataFrame({"at_us": at, "packed_data": [str(v) for v in values[: len(at)]] if dedupe else None, "n": range(len(at))})
    step = throttle.MinGap(gap, dedupe, "n int")
    state = None if entry is None else [str(entry[0]) if dedupe else None, entry[1]]
    summed = json.loads(json.dumps(step.sum_up(rows)))
    assert step.pass_through(state, summed) == _state_after(step, state, rows)


@pytest.mark.parametrize("data", [[], ["v"]])
def test_regular_ticks_take_two_walks(spark, monkeypatch, data):
    """Twenty cuts of regular ticks, where the rows kept in a cut depend on all cuts before it."""
    walks = []
    for name in ("_walker", "_summing"):
        made = getattr(folds, name)
        monkeypatch.setattr(folds, name, lambda *a, made=made, name=name: walks.append(name) or made(*a))
    rows = spark.range(2000).selectExpr("1 AS k", "id", "timestamp_micros(id * 1000000) AS ts", "id DIV 3 % 2 AS v")
    found = throttle.min_gap(rows, ["k"], ["id"], "ts", data, 7, 100) if data else throttle.rate_limit(rows, ["k"], ["id"], "ts", 7, 100)
    kept = sorted(r.id for r in found.collect())
    assert walks == ["_summing", "_walker"]
    wanted, last = [], None
    for i in range(2000):
        if last is None or i - last >= 7 and (not data or i // 3 % 2 != last // 3 % 2):
            wanted.append(i)
            last = i
    assert kept == wanted


def test_times_that_go_back_are_walked(spark):
    rng = random.Random(3)
    data = [(1, i, i + rng.choice([0, 0, 0, -30]), rng.randint(0, 3)) for i in range(1500)]
    rows = spark.createDataFrame(data, "k int, id int, s int, v int").withColumn("ts", F.timestamp_seconds("s"))
    kept, last = [], None
    for _, i, s, v in data:
        if last is None or (v != last[1] and s - last[0] >= 5):
            kept.append(i)
            last = (s, v)
    assert sorted(r.id for r in throttle.min_gap(rows, ["k"], ["id"], "ts", ["v"], 5, 100).collect()) == kept


def test_state_table_throttled_over_one_layout(frames):
    columns = [FieldColumn(1, 3, 11, 0, "w")]
    laid = register_state(pair_run(frames), columns, min_gap_seconds=60)
    plain = register_state(rows_of(pair_run(frames)), columns, min_gap_seconds=60, rows_per_cut=10**9)
    assert sorted(map(tuple, laid.collect())) == sorted(map(tuple, plain.collect()))


def test_islands_and_gaps_take_a_layout(spark, small_cuts):
    rows = spark.range(3000).selectExpr("id % 2 AS k", "id AS at", "timestamp_seconds(id) AS ts", "id % 7 < 4 AS bad")
    laid = lay_out(rows, ["k"], ["at"])
    for work in (lambda x, n: changes.islands(x, ["k"], ["at"], F.col("bad"), "ts", 1, n), lambda x, n: changes.gap_us(x, ["k"], ["at"], "ts", "gap_us", n)):
        assert sorted(map(str, work(laid, None).collect())) == sorted(map(str, work(rows, 10**9).collect()))


def test_intervals_of_all_registers_and_their_pivot(spark, small_cuts):
    """Intervals against a plain dictionary, and the wide form at given times."""
    rng = random.Random(8)
    data, held, spans = [], {}, []
    for i in range(3000):
        row = (f"c{i % 5 // 4}", i, 1 + i % 2, 3, rng.randrange(40), rng.randrange(3))
        data.append(row)
        key = (row[0], row[2], row[3], row[4])
        if key not in held or held[key][1] != row[5]:
            if key in held:
                spans.append((*key, held[key][1], held[key][0], i))
            held[key] = (i, row[5])
    spans += [(*k, v, at, None) for k, (at, v) in held.items()]
    updates = spark.createDataFrame(data, "capture_id string, pair_off long, device int, fc int, reg int, value int").withColumn("ts", F.timestamp_seconds(F.col("pair_off") * 2))
    found = state_intervals(updates)
    rows = found.select("capture_id", "device", "fc", "reg", "value", "from_pair_off", "to_pair_off").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, spans))
    columns = [FieldColumn(1, 3, 7, 0, "w"), FieldColumn(2, 3, 9, 0, "w")]
    asked = spark.createDataFrame([("c0", 0), ("c0", 2001), ("c0", 5998), ("c1", 3000), ("c2", 5)], "capture_id string, s long").select("capture_id", F.timestamp_seconds("s").alias("ts"))
    wide = {(r[0], int(r[1].timestamp())): tuple(r[2:]) for r in pivot_state(found, columns, asked).collect()}
    for (capture, second), values in wide.items():
        for column, value in zip(columns, values, strict=True):
            before = [v for c, at, d, f, r, v in data if c == capture and 2 * at <= second and (d, f, r) == (column.device, column.fc, column.reg)]
            assert value == (before[-1] if before else None)
    assert len(wide) == 5
