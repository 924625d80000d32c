"""What stored rows and shuffles take: columns in buckets, written once, and no shuffle of rows that are in place."""

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wiretide.operators import changes, runs, stats
from wiretide.operators.decode import register_updates, wire_table
from wiretide.operators.pairing import pair_latest, pair_pending, pair_run
from wiretide.operators.registers import state_intervals
from wiretide.operators.runs import CUT, lay_out, run
from wiretide.operators.framing import frame_run, frames_only
from wiretide.sources.hexdump import parse_lines, rejected_lines

ASK, ANSWER = "0103000000044409", "01030800010002000300040d14"
START = datetime(2026, 1, 1)


def chunks(spark):
    rows = []
    for i in range(160):
        frame = bytes.fromhex(ANSWER if i % 2 else ASK)
        if i % 14 != 9:  # some answers are lost
            rows.append(("ab"[i // 100], i, START, frame))
    return spark.createDataFrame(rows, "capture_id string, line int, ts timestamp_ntz, bytes binary")


@pytest.fixture
def kept(monkeypatch):
    """What is stored, as it is asked for."""
    found, made = [], {n: getattr(runs, n) for n in ("checkpointed", "checkpointed_as_dealt")}
    for name in made:
        monkeypatch.setattr(runs, name, lambda x, name=name: found.append(name) or made[name](x))
    return found


@pytest.fixture
def laid(spark):
    return frames_only(frame_run(lay_out(chunks(spark), ["capture_id"], ["line"], 10), order=["line"]))


def plain(spark):
    return frames_only(frame_run(chunks(spark), order=["line"], rows_per_cut=10**9)).done()


def text(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0].count("Exchange hashpartitioning")


def test_stored_rows_are_compressed_columns_in_buckets(spark):
    tables = len(spark.catalog.listTables())
    laid = lay_out(spark.range(3000).selectExpr("id % 3 AS k", "id * 7 % 3001 AS at", "cast(id AS string) AS v"), ["k"], ["at"], 200)
    files = laid.df.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files) and len(spark.catalog.listTables()) == tables

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2)], ["k", "cut", "at"])

    # one task has all rows of a key and cut, in order, also if nothing else in the plan asks for it
    rows = laid.in_order().select("k", CUT, "at").mapInArrow(seen, "k long, cut int, at long")
    parts = rows.select(F.spark_partition_id().alias("task"), "*").toPandas()
    assert len(parts) == 3000 and (parts.groupby(["k", "cut"]).task.nunique() == 1).all()
    assert all(g["at"].is_monotonic_increasing for _, g in parts.groupby(["k", "cut"]))


def test_rows_no_table_can_hold_are_stored_too(spark):
    rows = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"), F.lit(None).alias("none"), F.lit(1).alias("x"), F.lit(2).alias("X"))
    laid = lay_out(rows, ["k"], ["at"], 50)
    assert laid.split and laid.lag({"before": F.col("at")}).done().where("before IS NULL").count() == 2


def test_frames_are_stored_by_their_walk_alone(spark, laid, kept):
    lines = lay_out(chunks(spark), ["capture_id"], ["line"], 10)
    del kept[:]
    frames = frame_run(lines, order=["line"])
    assert frames.split and frames.dealt and not kept
    assert text(frames_only(frames).done()) == text(plain(spark))


def test_queue_walks_stored_frames_as_they_are(spark, laid, kept):
    found = text(pair_pending(laid))
    assert not kept and found == text(pair_pending(plain(spark), rows_per_cut=10**9)) and len(found) > 60


def test_intervals_do_not_store_pairs(spark, laid, kept):
    found = text(state_intervals(register_updates(pair_run(laid), blocks=True)))
    assert not kept and found == text(state_intervals(register_updates(pair_run(run(plain(spark), ["capture_id"], ["off"], 10**9)), blocks=True)))


def test_newest_requests_are_paired_in_place(spark, laid):
    found = pair_latest(laid)
    assert not shuffles(found)
    twice = plain(spark)
    answers = twice.where("role = 'response'").withColumn("off", F.col("off") + 5)  # a second answer comes too late
    both = twice.unionByName(answers)
    assert len(text(found)) > 60 and text(found) == text(pair_latest(both, rows_per_cut=10**9)) == text(pair_latest(both, rows_per_cut=7))


def test_changes_of_decoded_rows_stay_in_their_cuts(spark, laid):
    wire = wire_table(pair_run(laid), fields=[])
    assert wire.split and wire.order == ("pair_off",)

    def found(rows):
        return changes.changes(rows, ["capture_id", "device"], ["pair_off"], "step")

    step = (F.col("pair_off") / 100).cast("int").alias("step")
    rows = wire.select("capture_id", "device", "pair_off", step)
    assert not shuffles(found(rows)) and text(found(rows)) == text(found(rows.done()))


def test_plain_lines_are_not_split_to_be_counted(spark):
    head = "2026-01-01 00:00:00.000  00000000  "
    lines = [head + v for v in ("01 02 |..|", "0102 03\t04 |....|", "0a| | |", "0 10 |..|", "01 0|.|", "01 02", "")] + [None, "2026-13-01 00:00:00.000  00000000  01 |.|"]
    df = spark.createDataFrame([("c", v) for v in lines], "capture_id string, value string")
    counted = rejected_lines(df)
    assert counted.collect() == [("c", len(lines), len(lines) - parse_lines(df).count())]
    assert "_by_place" in counted._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "string"])
def test_distinct_values_are_gathered_as_bits(spark, kind):
    rows = spark.range(4000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 > 0, (F.col("id") * 37 % 701 - 350)).cast(kind).alias("v"))
    rows = rows.unionByName(spark.sql(f"SELECT 1L AS k, cast(v AS {kind}) AS v FROM VALUES (2147483647L), (-2147483648L), (NULL) AS t(v)"))
    rows = rows.unionByName(spark.sql(f"SELECT 9L AS k, cast(NULL AS {kind}) AS v"))
    found = stats.distinct_profile(rows, ["k"], "v")
    want = rows.where("v IS NOT NULL").groupBy("k").agg(F.countDistinct("v").alias("n"))
    assert sorted((r.k, r.n_distinct) for r in found.collect()) == sorted(map(tuple, want.collect()))
    assert found.schema["n_distinct"].dataType.simpleString() == "bigint"
    assert ("bit_or" in found._jdf.queryExecution().executedPlan().toString()) == (kind in ("int", "bigint"))
