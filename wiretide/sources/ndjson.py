"""Poll and tag records: one JSON object per line, batch or as a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.sources.tail import tail_json

RECORD_SCHEMA = "ts STRING, fields MAP<STRING, STRING>"
TAG_SCHEMA = "ts STRING, tag STRING, source STRING"

# Field names the poller writes.
POLL_FIELDS = {
    "status": "string",
    "battery_charge_limit": "int",
    "battery_discharge_limit": "int",
    "v_battery": "double",
    "p_battery": "double",
    "temp_battery": "double",
    "soc": "double",
    "v_cells_sum": "double",
    "t_max": "double",
    "t_min": "double",
    "num_cycles": "int",
    "warning_1": "int",
    "warning_2": "int",
    "cap_remaining": "double",
    "cap_calibrated": "double",
} | {f"v_cell_{i:02d}": "double" for i in range(1, 17)}


def _paths(paths: str | Sequence[str]):
    return paths if isinstance(paths, str) else list(paths)


def _file_order(name: str | None) -> list[Column]:
    """A number that grows along a file, whatever tasks read it: where the row's block begins, plus
    the row's number in its task, which stays below the block's length."""
    if name is None:
        return []
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return [(F.col("_metadata.file_block_start") + nth).alias(name)]


def _flatten(records: DataFrame, fields: Mapping[str, str], extra: Sequence[Column]) -> DataFrame:
    """``ts`` plus one typed ``tcp_`` column per field; unusable values become NULL."""
    values = [F.col("fields")[name].try_cast(kind).alias(f"tcp_{name}") for name, kind in fields.items()]
    kept = records.where(F.col("ts").isNotNull())
    return kept.select(*extra, F.col("ts").try_cast("timestamp").alias("ts"), *values)


def read_polls(
    spark: SparkSession, paths: str | Sequence[str], fields: Mapping[str, str] | None = None,
    capture_id: Column | None = None, seq: str | None = None,
) -> DataFrame:
    """Polls, one row each; ``seq`` names a column for their order in the file, which decides between
    polls of equal time in ``join_streams``. Blank and malformed lines are skipped. ``capture_id`` is an
    expression over ``_metadata.file_path``. Without ``fields``, the columns are ``POLL_FIELDS`` and,
    as text, every other field that occurs; this reads the files once more."""
    if fields is None:
        others = {r["field"] for r in read_poll_keys(spark, paths).collect()} - POLL_FIELDS.keys()
        fields = POLL_FIELDS | dict.fromkeys(sorted(others), "string")
    records = spark.read.schema(RECORD_SCHEMA).option("mode", "DROPMALFORMED").json(_paths(paths))
    return _flatten(records, fields, [*([] if capture_id is None else [capture_id.alias("capture_id")]), *_file_order(seq)])


def read_poll_keys(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Field names that occur, to choose ``fields`` for files of unknown shape."""
    records = spark.read.schema(RECORD_SCHEMA).option("mode", "DROPMALFORMED").json(_paths(paths))
    return records.select(F.explode(F.map_keys("fields")).alias("field")).distinct()


def read_tags(spark: SparkSession, paths: str | Sequence[str], capture_id: Column | None = None, seq: str | None = None) -> DataFrame:
    """Tag events; a missing source is ``manual``. ``seq`` as in :func:`read_polls`."""
    records = spark.read.schema(TAG_SCHEMA).option("mode", "DROPMALFORMED").json(_paths(paths))
    extra = [*([] if capture_id is None else [capture_id.alias("capture_id")]), *_file_order(seq)]
    return records.where(F.col("ts").isNotNull() & F.col("tag").isNotNull()).select(
        *extra, F.col("ts").try_cast("timestamp").alias("ts"), "tag",
        F.coalesce("source", F.lit("manual")).alias("source"),
    )


def rejected_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines that are not JSON objects, counted per file; blank lines are not counted."""
    lines = spark.read.text(_paths(paths)).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v"))
    bad = F.try_parse_json("v").isNull() if hasattr(F, "try_parse_json") else F.from_json("v", "MAP<STRING,STRING>").isNull()
    return lines.where(F.col("v") != "").groupBy("path").agg(
        F.count("*").alias("lines"), F.count_if(bad).alias("rejected")
    )


def stream_polls(
    spark: SparkSession, folder: str, fields: Mapping[str, str] = POLL_FIELDS, start: str | None = None,
    files_per_trigger: int = 100,
) -> DataFrame:
    """Poll files as they arrive in a folder (whole files, so logs must be rotated into
    it). ``start`` skips older records. A stream has fixed columns: only ``fields`` are kept."""
    records = (
        spark.readStream.schema(RECORD_SCHEMA)
        .option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )
    rows = _flatten(records, fields, [])
    return rows if start is None else rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))


def tail_polls(
    spark: SparkSession, path: str, fields: Mapping[str, str] = POLL_FIELDS, start: str | None = None, pattern: str = "*",
) -> DataFrame:
    """Polls as they are appended to growing files; a record whose line is not whole yet waits."""
    rows = _flatten(tail_json(spark, path, RECORD_SCHEMA, pattern), fields, [])
    return rows if start is None else rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))


def tail_tags(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Tag events as they are appended; a missing source is ``manual``."""
    records = tail_json(spark, path, TAG_SCHEMA, pattern)
    return records.where(F.col("ts").isNotNull() & F.col("tag").isNotNull()).select(
        F.col("ts").try_cast("timestamp").alias("ts"), "tag", F.coalesce("source", F.lit("manual")).alias("source"),
    )
