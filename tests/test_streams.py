"""Streams give what batch gives on the same input."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import noisy_traffic, plain_walk
from wiretide.operators.changes import auto_tags
from wiretide.operators.framing import frames_only
from wiretide.operators.pairing import pair_pending
from wiretide.operators.throttle import rate_limit
from wiretide.sources.ndjson import stream_polls
from wiretide.streaming.processors import (
    stream_auto_tags,
    stream_frames,
    stream_last_known,
    stream_min_gap,
    stream_pending,
    use_rocksdb,
)

START = datetime(2026, 5, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    use_rocksdb(spark)


def drain(spark, stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(180)
    return spark.table(name).collect()


def in_files(spark, df, tmp_path, name, parts):
    """Parquet files that a stream takes one by one, in order."""
    folder = tmp_path / f"in_{name}"
    for part in range(parts):
        df.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_frames_and_pending(spark, tmp_path):
    data = noisy_traffic(random.Random(3), 60, 0.004)
    pieces = [data[i : i + 16] for i in range(0, len(data), 16)]
    rows = [("a", i, START + timedelta(milliseconds=i), bytearray(p), i * 3 // len(pieces)) for i, p in enumerate(pieces)]
    df = spark.createDataFrame(rows, "capture_id string, line int, ts timestamp_ntz, bytes binary, part int")
    live = in_files(spark, df, tmp_path, "chunks", 3)
    got = drain(spark, stream_frames(live, order=["line"]), tmp_path, "live_frames")
    want, _ = plain_walk(data)
    mine = sorted((r.off, r.len, r.role, r.swap) for r in got)
    assert mine == want[: len(mine)] and len(want) - len(mine) <= 2  # the open tail waits

    frames = spark.createDataFrame(got, spark.table("live_frames").schema).withColumn("part", (F.col("off") * 3 / len(data)).cast("int"))
    batch = sorted(tuple(r) for r in pair_pending(frames).collect())
    live = in_files(spark, frames, tmp_path, "frames", 3)
    assert sorted(tuple(r) for r in drain(spark, stream_pending(live), tmp_path, "live_pairs")) == batch
    assert batch


def test_rate_limit_tags_and_registers(spark, tmp_path):
    rnd = random.Random(9)
    rows = [
        ("ab"[i % 2], i, START + timedelta(seconds=i), rnd.choice(["idle", "charge", None]), rnd.randint(1, 3), rnd.randint(0, 2), i // 20)
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "capture_id string, seq int, ts timestamp, mode string, reg int, value int, part int")
    keys, order = ["capture_id"], ["seq"]
    live = in_files(spark, df, tmp_path, "events", 3)

    kept = drain(spark, stream_min_gap(live, keys, order, "ts", 7), tmp_path, "live_kept")
    want = rate_limit(df, keys, order, "ts", 7).select("capture_id", "seq").collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, want))

    tags = drain(spark, stream_auto_tags(live, keys, order, "mode"), tmp_path, "live_tags")
    assert sorted(map(tuple, tags)) == sorted(map(tuple, auto_tags(df, keys, order, "mode").collect()))

    regs = live.withColumns({"device": F.lit(1), "fc": F.lit(3)})
    seen = drain(spark, stream_last_known(regs, keys, order), tmp_path, "live_regs")
    image = {}
    for r in sorted(rows, key=lambda r: r[1]):
        image[(r[0], r[4])] = r[5]
    assert {(r.capture_id, r.reg): r.value for r in seen if (r.capture_id, r.reg) in image}.keys() == image.keys()
    newest = {}
    for r in seen:  # micro-batches arrive in order
        newest[(r.capture_id, r.reg)] = r.value
    assert newest == image


def test_poll_folder(spark, tmp_path):
    folder = tmp_path / "polls"
    folder.mkdir()
    lines = [json.dumps({"ts": f"2026-05-02T10:00:0{i}+00:00", "fields": {"soc": 50 + i}}) for i in range(3)]
    (folder / "a.json").write_text("\n".join(lines + ["", "{broken"]))
    got = drain(spark, stream_polls(spark, str(folder), {"soc": "int"}, start="2026-05-02 10:00:01"), tmp_path, "live_polls")
    assert sorted(r.tcp_soc for r in got) == [51, 52]


def test_frames_only_drops_the_closing_row(spark):
    df = spark.createDataFrame([(1, "request"), (2, None)], "off int, role string")
    assert frames_only(df).count() == 1
