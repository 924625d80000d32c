"""Results to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.functions.binary import hex_word, to_signed16
from wiretide.functions.scalar import timestamp_text
from wiretide.operators.redact import is_text_path, redact_hex, redact_text


def write_joined(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Joined table, one folder per capture and day; rows of a folder are brought
    together by range, so a large capture still spreads over many files."""
    dated = df.withColumn("date", F.to_date("ts"))
    dated.repartitionByRange("capture_id", "date", "ts").write.mode(mode).partitionBy("capture_id", "date").parquet(path)


def state_csv_rows(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    return state.select("capture_id", "pair_off", timestamp_text(F.col("ts")).alias("timestamp"), *columns)


def write_state_csv(state: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """Register-state CSV per capture in stream order; unknown values are empty cells."""
    rows = state_csv_rows(state, columns).repartitionByRange("capture_id", "pair_off")
    ordered = rows.sortWithinPartitions("capture_id", "pair_off").drop("pair_off")
    ordered.write.mode(mode).option("header", True).option("emptyValue", "").partitionBy("capture_id").csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """Append records."""
    df.write.mode("append").json(path)


REGISTER_TYPES = {3: "holding", 4: "input"}  # fixed values


def register_log_rows(readings: DataFrame) -> DataFrame:
    """Single-register log: time, device, register, value in hex, unsigned and signed."""
    kind = F.when(F.col("fc") == 3, REGISTER_TYPES[3]).otherwise(REGISTER_TYPES[4])
    return readings.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("datetime"),
        F.col("device").alias("device_id"),
        F.concat_ws(":", kind, F.col("reg").cast("string")).alias("register"),
        hex_word(F.col("value")).alias("value_hex"),
        F.col("value").alias("value_unsigned"),
        to_signed16(F.col("value")).alias("value_signed"),
    )


def register_log_text(readings: DataFrame) -> DataFrame:
    kind = F.when(F.col("fc") == 3, REGISTER_TYPES[3]).otherwise(REGISTER_TYPES[4])
    return readings.select(
        F.format_string(
            "%s device=%d %s[%d]=0x%04X (%d)",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "device", kind, "reg", "value", "value",
        ).alias("value")
    )


def write_register_log(readings: DataFrame, path: str, csv: bool = True) -> None:
    if csv:
        register_log_rows(readings).write.mode("append").option("header", True).csv(path)
    else:
        register_log_text(readings).write.mode("append").text(path)


def write_hexdump(lines: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """Log lines (``capture_id, *order, piece, value``) as text, in order, per capture."""
    keys = ["capture_id", *order, "piece"]
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("capture_id", "value").write.mode(mode).partitionBy("capture_id").text(path)


def redact_text_files(
    spark: SparkSession, paths: str | Sequence[str], out: str, serials: Sequence[str] = (), ips: Sequence[str] = (),
) -> None:
    """Redacted copy of text files, one folder per file, line order kept."""
    path = F.col("_metadata.file_path")
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    lines = lines.where(is_text_path(F.col("path"))).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    order = ["file", "path", "block", "line"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("file", redact_text(F.col("value"), serials, ips).alias("value")).write.partitionBy("file").text(out)


def redact_binary_files(spark: SparkSession, paths: str | Sequence[str], serials: Sequence[str] = ()) -> DataFrame:
    """``(path, content)`` of binary files with serials masked. Captures should be
    redacted as frames instead, which keeps their CRC right."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return files.where(~is_text_path(F.col("path"))).select("path", redact_hex(F.col("content"), serials).alias("content"))


def redact_files(
    spark: SparkSession, paths: str | Sequence[str], out: str, serials: Sequence[str] = (), ips: Sequence[str] = (),
) -> None:
    """Redacted copy of all files, whatever their kind: text under ``out``/text, one folder per file,
    the others as rows ``(path, content)`` under ``out``/binary. Nothing of a mixed folder is lost."""
    redact_text_files(spark, paths, f"{out}/text", serials, ips)
    redact_binary_files(spark, paths, serials).write.parquet(f"{out}/binary")


def capture_from_path(depth: int = 1) -> Column:
    """Name of the folder ``depth`` levels above a file, for ``capture_id``."""
    return F.element_at(F.split(F.col("path"), "/"), F.lit(-1 - depth))
