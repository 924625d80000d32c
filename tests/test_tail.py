"""Growing logs: whole lines only, byte ranges, restarts, and the way to pairs."""

import io
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from tests.frames import noisy_traffic
from wiretide.operators.framing import frames_only
from wiretide.operators.pairing import pair_pending
from wiretide.plans.pipelines import frames_from_lines
from wiretide.sources import tail
from wiretide.sources.hexdump import parse_lines, scan_lines
from wiretide.sources.ndjson import tail_polls, tail_tags
from wiretide.streaming.processors import stream_frames, stream_pending, use_rocksdb


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=9).map(lambda b: b.replace(b"\n", b"")), max_size=12), st.binary(max_size=4), st.integers(1, 20), st.integers(1, 7), st.data())
def test_ranges_give_every_whole_line_once(lines, rest, size, block, data):
    text = b"".join(x + b"\n" for x in lines) + rest.replace(b"\n", b"")
    kept, tail.BLOCK_BYTES = tail.BLOCK_BYTES, block
    try:
        file, starts = Bytes(text), [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines) + 1)]
        assert tail.whole_lines(file, len(text)) == starts[-1]
        first = data.draw(st.sampled_from(starts))
        reader = tail.TailReader("/logs", "*", size)
        parts = reader.partitions({"files": {"f": first}}, {"files": {"f": starts[-1]}})
        found = [row for part in parts for row in tail.lines_in(file, part)]
        assert found == [(at, line) for at, line in zip(starts, lines) if at >= first]
    finally:
        tail.BLOCK_BYTES = kept


def log(rows):
    """Hexdump lines of ``(time, bytes)``."""
    out, at = io.StringIO(), 0
    for ts, data in rows:
        stamp = ts.strftime("%Y-%m-%d %H:%M:%S.") + f"{ts.microsecond // 1000:03d}"
        text = "".join(chr(b) if 32 <= b < 127 else "." for b in data)
        out.write(f"{stamp}  {at:08x}  {' '.join(f'{b:02X}' for b in data):<48} |{text}|\n")
        at += len(data)
    return out.getvalue().encode()


def drain(stream, folder, sink):
    query = stream.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert query.awaitTermination(180)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    use_rocksdb(spark)


def test_text_to_pairs_with_a_restart(spark, tmp_path):
    """Logs grow between three runs of a query, twice in the middle of a line; frames and pairs are
    those of the finished logs in one batch."""
    start, logs = datetime(2026, 5, 1), tmp_path / "logs"
    logs.mkdir()
    whole = {}
    for name, seed in (("a.log", 3), ("b.log", 4)):
        data = noisy_traffic(random.Random(seed), 60, 0.004)
        whole[name] = log([(start + timedelta(milliseconds=i), data[i : i + 16]) for i in range(0, len(data), 16)])
    lines = tail.tail_hexdump(spark, str(logs), "*.log", range_bytes=700)
    for share in (0.31, 0.64, 1.0):
        for name, text in whole.items():
            (logs / name).write_bytes(text[: int(len(text) * share)])
        drain(stream_frames(parse_lines(lines)), tmp_path / "check_frames", tmp_path / "frames")
    live = spark.read.parquet(str(tmp_path / "frames"))
    walked = frames_only(frames_from_lines(scan_lines(spark, str(logs))))
    key = lambda r: (r.capture_id.rsplit("/", 1)[-1], r.off, r.len, r.role, bytes(r.raw))
    mine, wanted = sorted(map(key, live.collect())), sorted(map(key, walked.collect()))
    assert set(mine) <= set(wanted) and len(mine) == len(set(mine)) and len(wanted) - len(mine) <= 4  # open tails wait
    again = spark.readStream.schema(live.schema).parquet(str(tmp_path / "frames"))
    drain(stream_pending(again), tmp_path / "check_pairs", tmp_path / "pairs")
    pairs = sorted(tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "pairs")).collect())
    assert pairs == sorted(tuple(r)[1:] for r in pair_pending(live).collect()) and len(pairs) > 50


def test_a_file_that_grows_is_replaced_and_goes(spark, tmp_path):
    folder, sink = tmp_path / "in", tmp_path / "out"
    stream = tail.tail_text(spark, str(folder))
    for contents in ({"x": "one\ntw"}, {"x": "one\ntwo\r\nthree"}, {"x": "new\n", "y": "é\n\n"}, {}):
        folder.mkdir(exist_ok=True)
        for old in folder.iterdir():
            old.unlink()
        for name, text in contents.items():
            (folder / name).write_bytes(text.encode())
        drain(stream, tmp_path / "check", sink)
    rows = sorted((r.path[-1], r.start, r.value) for r in spark.read.parquet(str(sink)).collect())
    assert rows == [("x", 0, "new"), ("x", 0, "one"), ("x", 4, "two"), ("y", 0, "é"), ("y", 3, "")]
    assert isinstance(tail.TailReader(str(folder), "*", 1)._system()[0], fs.LocalFileSystem)


def test_polls_and_tags_as_they_are_appended(spark, tmp_path):
    folder = tmp_path / "polls"
    folder.mkdir()
    line = '{"ts": "2026-05-01T00:00:0%d+00:00", "fields": {"soc": %d}, "tag": "t%d"}\n'
    for upto in (1, 3):
        whole = "".join(line % (i, 50 + i, i) for i in range(upto))
        (folder / "p.ndjson").write_text(whole + ("not json\n" if upto == 3 else "") + line[:20])
        for name, stream in (("polls", tail_polls(spark, str(folder))), ("tags", tail_tags(spark, str(folder)))):
            drain(stream, tmp_path / f"check_{name}", tmp_path / f"out_{name}")
    found = {n: spark.read.parquet(str(tmp_path / f"out_{n}")).collect() for n in ("polls", "tags")}
    assert sorted(r.tcp_soc for r in found["polls"]) == [50, 51, 52]
    assert sorted((r.tag, r.source) for r in found["tags"]) == [(f"t{i}", "manual") for i in range(3)]
