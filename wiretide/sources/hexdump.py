"""Hexdump logs: text lines to byte chunks, and back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType, TimestampNTZType

from wiretide.functions.binary import payload, pieces
from wiretide.operators.runs import Run, rows_of, run

BYTES_PER_LINE = 16
#: What stands between the parts of a line, and what opens and closes the text column.
BLANKS, BAR = r"[ \t]+", "|"

#: A line as the logger lays it out: every part at its own place. Its time has ``STAMP`` characters,
#: its offset eight digits, and its bytes begin at character ``FIRST``.
HEX = "[0-9A-Fa-f]"
PLAIN = rf"(?s)\A\d\d\d\d-\d\d-\d\d \d\d:\d\d:\d\d\.\d\d\d  {HEX * 8}  (?:{HEX}{HEX} ){{1,16}}+ *+\|."
STAMP, OFFSET, FIRST = 23, 26, 36

LINE_ORDER = ["path", "block", "line"]

_DIGIT, _BLANK = np.full(256, 255, np.uint8), ord(" ")
_DIGIT[[*b"0123456789abcdef", *b"ABCDEF"]] = [*range(16), *range(10, 16)]
#: Head of a plain line: where it has a fixed character, and where a decimal or hex digit.
_HEAD = np.frombuffer(b"0000-00-00 00:00:00.000  xxxxxxxx  ", np.uint8)
_FIXED, _DECIMAL, _HEX = (np.flatnonzero(x) for x in (~np.isin(_HEAD, [*b"0x"]), _HEAD == ord("0"), _HEAD == ord("x")))
_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def scan_lines(spark: SparkSession, paths: str | Sequence[str], capture_id: Column | None = None) -> DataFrame:
    """Raw log lines with their file order. ``capture_id`` is an expression over ``path``;
    by default each file, by its full path, is one capture. Line numbers grow within a file block, which is
    all that ordering needs, so large files are read in parallel."""
    read = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    lines = read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    name = F.col("path") if capture_id is None else capture_id
    return lines.select(name.alias("capture_id"), *LINE_ORDER, "value")


def _parts(value: str) -> Column:
    """The parts before the text column: date, time, offset and, as one part, all hex bytes. Without
    a text column, which is enclosed in bars, there are none."""
    line = F.rtrim(F.col(value))
    enclosed = line.endswith(BAR) & (F.instr(line, BAR) < F.length(line))
    return F.when(enclosed, F.split(F.rtrim(F.substring_index(line, BAR, 1)), BLANKS, 4)).otherwise(F.array().cast("array<string>"))


def _well_formed(parts: Column) -> Column:
    """Whether the offset is hex and the bytes are hex digits in pairs, with no blank at their end.
    Possessive loops take no stack, however long the line."""
    offset, digits = F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    return offset.rlike(r"\A[0-9A-Fa-f]++\z") & digits.rlike(r"\A(?:[0-9A-Fa-f]{2}[ \t]*+)++(?<![ \t])\z")


def _micros(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 from the digits of stamps, and whether there is such a time."""
    d = digits.astype(np.int32)
    year, month, day = d[:, 0] * 1000 + d[:, 1] * 100 + d[:, 2] * 10 + d[:, 3], d[:, 4] * 10 + d[:, 5], d[:, 6] * 10 + d[:, 7]
    hour, minute, second = d[:, 8] * 10 + d[:, 9], d[:, 10] * 10 + d[:, 11], d[:, 12] * 10 + d[:, 13]
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = _MONTH_DAYS[np.minimum(month, 12)] + (leap & (month == 2))
    real = (year > 0) & (month > 0) & (month < 13) & (day > 0) & (day <= days) & (hour < 24) & (minute < 60) & (second < 60)
    first = np.array((year - 1970) * 12 + month - 1, "datetime64[M]").astype("datetime64[D]").astype(np.int64)
    seconds = (first + day - 1) * 86_400 + hour * 3_600 + minute * 60 + second
    return (seconds * 1_000 + d[:, 14] * 100 + d[:, 15] * 10 + d[:, 16]) * 1_000, real


@F.arrow_udf(StructType([StructField("ts", TimestampNTZType()), StructField("offset", LongType()), StructField("bytes", BinaryType())]))
def _by_place(value: pa.Array) -> pa.Array:
    """Fields of ``PLAIN`` lines that end with the text column and have a time that exists, vectorised over
    each Arrow batch; NULL for all other lines, which may be well-formed as well."""
    text, at, size = payload(value)
    rows = np.flatnonzero(size > FIRST + 3)
    rows = rows[text[at[rows] + size[rows] - 1] == ord(BAR)]
    # What is read behind the end of a line is behind its bar, too.
    line = pieces(text, len(_HEAD) + 3 * BYTES_PER_LINE + 2, at[rows])
    head = line[:, : len(_HEAD)]
    decimal, offset = _DIGIT[head[:, _DECIMAL]], _DIGIT[head[:, _HEX]]
    micros, real = _micros(decimal)
    good = real & (head[:, _FIXED] == _HEAD[_FIXED]).all(1) & (decimal < 10).all(1) & (offset < 16).all(1)
    rows, micros, offset, cells = rows[good], micros[good], offset[good], line[good, len(_HEAD) :]
    # Bytes are two digits and a blank; then there are only blanks up to a bar that is not the last character.
    triples = cells[:, :-2].reshape(-1, BYTES_PER_LINE, 3)
    high, low = _DIGIT[triples[:, :, 0]], _DIGIT[triples[:, :, 1]]
    paired = ((high | low) < 16) & (triples[:, :, 2] == _BLANK)
    count = np.c_[paired, np.zeros(len(paired), bool)].argmin(1)
    bars = (cells != _BLANK) & (np.arange(cells.shape[1], dtype=np.int8) >= 3 * count.astype(np.int8)[:, None])
    bar = bars.argmax(1)
    good = (count > 0) & (cells[np.arange(len(rows)), bar] == ord(BAR)) & (len(_HEAD) + bar < size[rows] - 1)
    rows, count = rows[good], count[good]
    data = (high << 4 | low)[good][np.arange(BYTES_PER_LINE) < count[:, None]]
    taken, sizes = np.zeros(len(value), bool), np.zeros(len(value), np.int32)
    taken[rows], sizes[rows] = True, count
    stamps, offsets = np.zeros((2, len(value)), np.int64)
    stamps[rows] = micros[good]
    offsets[rows] = (offset[good].astype(np.int64) << np.arange(28, -4, -4)).sum(1)
    ends = np.r_[np.int32(0), np.cumsum(sizes, dtype=np.int32)]
    chunks = pa.Array.from_buffers(pa.binary(), len(value), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
    fields = [pa.array(stamps).cast(pa.timestamp("us")), pa.array(offsets), chunks]
    return pa.StructArray.from_arrays(fields, names=["ts", "offset", "bytes"], mask=pa.array(~taken))


def _stamp(parts: Column) -> Column:
    return F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).try_cast("timestamp_ntz")


def parse_lines(lines: DataFrame | Run, value: str = "value") -> DataFrame | Run:
    """Byte chunks of well-formed lines; other lines are skipped. The offset column is
    informative only: chunks follow each other in file order. Lines that are laid out stay so.
    Plain lines are taken apart by place and in batches; of those that are not, parts are taken from their
    places if they are plain but for their time or length, and others are split (``p``)."""
    kept = [c for c in rows_of(lines).columns if c != value]
    plain, text, p = F.coalesce(F.col(value).endswith(BAR) & F.col(value).rlike(PLAIN), F.lit(False)), F.col(value), F.col("p")
    done, b = F.col("b").isNotNull(), F.col("b")
    # explode keeps the filters below from looking at the line again
    placed = lines.select(*kept, value, _by_place(text).alias("b"))
    split = placed.select(*kept, value, "b", F.explode(F.array(F.when(~done, F.when(~plain, _parts(value))))).alias("p"))
    parts = split.where(p.isNull() | _well_formed(p))
    hexed = F.substring_index(F.substring(text, FIRST, 3 * BYTES_PER_LINE + 1), BAR, 1)
    stamp = F.when(p.isNull(), F.substring(text, 1, STAMP)).otherwise(F.concat_ws(" ", F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    offset = F.when(p.isNull(), F.substring(text, OFFSET, 8)).otherwise(F.get(p, F.lit(2)))
    digits = F.when(p.isNull(), F.replace(hexed, F.lit(" "))).otherwise(F.replace(F.replace(F.get(p, F.lit(3)), F.lit(" ")), F.lit("\t")))
    fields = parts.select(
        *kept,
        F.when(done, b["ts"]).otherwise(stamp.try_cast("timestamp_ntz")).alias("ts"),
        F.when(done, b["offset"]).otherwise(F.conv(offset, 16, 10).cast("bigint")).alias("offset"),
        F.when(done, b["bytes"]).otherwise(F.unhex(digits)).alias("bytes"),
    )
    return fields.where(F.col("ts").isNotNull())


def rejected_lines(lines: DataFrame | Run, value: str = "value") -> DataFrame:
    """How many lines per capture :func:`parse_lines` skips. It takes those that are read by their places; only
    others are split and judged part by part."""
    read = rows_of(lines).select("capture_id", value, _by_place(F.col(value)).isNotNull().alias("done"))
    parts = read.select("capture_id", "done", F.explode(F.array(F.when(~F.col("done"), _parts(value)))).alias("p"))
    good = F.col("done") | (_well_formed(F.col("p")) & _stamp(F.col("p")).isNotNull())
    bad = ~F.coalesce(good, F.lit(False))
    return parts.groupBy("capture_id").agg(F.count("*").alias("lines"), F.count_if(bad).alias("rejected"))


def read_hexdump(spark: SparkSession, paths: str | Sequence[str], capture_id: Column | None = None) -> DataFrame:
    return parse_lines(scan_lines(spark, paths, capture_id))


def with_session(chunks: DataFrame, order: Sequence[str] = LINE_ORDER, rows_per_cut: int | None = None) -> DataFrame:
    """Number the logger restarts inside a capture: the offset falls back."""
    seen = run(chunks, ["capture_id"], order, rows_per_cut).lag({"__prev": F.col("offset")})
    restart = F.coalesce(F.col("offset") < F.col("__prev"), F.lit(False)).cast("int")
    marked = seen._with(seen.df.withColumn("__restart", restart))
    return marked.running_sum({"session_id": F.col("__restart")}).done().drop("__prev", "__restart")


_PRINTED = np.array([c if 0x20 <= c <= 0x7E else ord(".") for c in range(256)], np.uint8)
#: Two hex digits of each byte in one number, and two blanks.
_PAIRS = np.frombuffer(b"".join(b"%02X" % c for c in range(256)) + b"  ", np.uint16)
_LOWER = np.frombuffer(b"0123456789abcdef", np.uint8)


@F.arrow_udf(ArrayType(StringType()))
def _lines(stamp: pa.Array, start: pa.Array, data: pa.Array) -> pa.Array:
    """The lines of each flush, vectorised over each Arrow batch; lines without a time are NULL."""
    raw, at, size = payload(data)
    times, time_at, time_size = payload(stamp)
    per = -(-size // BYTES_PER_LINE)
    first = np.r_[0, np.cumsum(per)]
    flush = np.repeat(np.arange(len(per)), per)
    piece = BYTES_PER_LINE * (np.arange(first[-1]) - first[flush])
    n = np.minimum(size[flush] - piece, BYTES_PER_LINE)
    place = start.fill_null(0).to_numpy()[flush] + piece
    width = np.full(len(flush), 8)
    for more in range(9, 17):  # offsets of more than eight digits
        width += place >> 4 * (more - 1) > 0
    there = ~stamp.is_null().to_numpy(zero_copy_only=False)[flush]
    sizes = np.where(there, time_size[flush] + width + 3 * BYTES_PER_LINE + 7 + n, 0)
    ends = np.r_[0, np.cumsum(sizes)]
    out = np.empty(ends[-1], np.uint8)
    # Lines whose stamps and offsets are equally long have all parts at the same places.
    for shape in np.unique(time_size[flush] * 32 + width):
        t, w = divmod(int(shape), 32)
        rows = np.flatnonzero(there & (time_size[flush] == t) & (width == w))
        if not len(rows):
            continue
        inside = np.arange(BYTES_PER_LINE) < n[rows][:, None]
        cells = pieces(raw, BYTES_PER_LINE, at[flush[rows]] + piece[rows])
        line = np.full((len(rows), t + w + 3 * BYTES_PER_LINE + 7 + BYTES_PER_LINE), _BLANK, np.uint8)
        line[:, :t] = pieces(times, t, time_at[flush[rows]])
        line[:, t + 2 : t + 2 + w] = _LOWER[place[rows][:, None] >> np.arange(4 * (w - 1), -4, -4) & 15]
        pairs = _PAIRS[np.where(inside, cells, np.int16(256))].view(np.uint8)
        line[:, t + w + 4 : t + w + 52 : 3], line[:, t + w + 5 : t + w + 52 : 3] = pairs[:, ::2], pairs[:, 1::2]
        line[:, t + w + 53] = ord(BAR)
        line[:, t + w + 54 : -1] = _PRINTED[cells]
        line[np.arange(len(rows)), t + w + 54 + n[rows]] = ord(BAR)
        kept = np.arange(line.shape[1], dtype=np.int16) < sizes[rows].astype(np.int16)[:, None]
        if len(rows) == len(flush):
            out = line[kept]
        else:
            out[(ends[rows][:, None] + np.arange(line.shape[1]))[kept]] = line[kept]
    values = pa.LargeStringArray.from_buffers(len(flush), pa.py_buffer(ends), pa.py_buffer(out.tobytes()), pa.array(there).buffers()[1])
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values.cast(pa.string()))


def format_run(flushes: DataFrame | Run, order: Sequence[str], rows_per_cut: int | None = None) -> Run:
    """:func:`format_hexdump` as a run ordered by ``order`` and ``piece``: flushes that are laid out
    hand their cuts to their lines."""
    size = F.length("bytes").cast("bigint")
    placed = run(flushes, ["capture_id"], order, rows_per_cut).running_sum({"__end": size}).where(size > 0)
    lines = _lines(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.col("__end") - size, F.col("bytes"))
    rows = placed.select("capture_id", *order, F.posexplode(lines).alias("__nth", "value"))
    return rows.select("capture_id", *order, (F.col("__nth") * BYTES_PER_LINE).alias("piece"), "value", order=[*order, "piece"])


def format_hexdump(flushes: DataFrame | Run, order: Sequence[str], rows_per_cut: int | None = None) -> DataFrame:
    """Log lines of byte flushes ``(capture_id, *order, ts, bytes)``: 16 bytes a line,
    running offset, unprintable bytes as dots. Adds ``piece``, the line within a flush."""
    return format_run(flushes, order, rows_per_cut).done()
