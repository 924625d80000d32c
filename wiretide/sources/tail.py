"""Growing text logs as a stream, line by line, by byte offsets.

Spark's file stream takes whole files and takes them once. A logger appends: so this source keeps a
byte offset for each file. A batch is what whole lines were added to any file since the last one; a
line without its end stays in the file until its end arrives. Offsets are committed with the
checkpoint of the query, so a restart goes on behind the last committed line, neither losing nor
repeating one.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start bigint, value string"
#: Bytes that a task reads, and bytes read at a time.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
NEWLINE = b"\n"


@dataclass
class LineRange(InputPartition):
    """Lines that begin at ``low`` or later and before ``high``. ``first`` begins a line, ``end``
    ends one, and ``low`` and ``high`` lie between them."""

    path: str
    low: int
    high: int
    first: int
    end: int


def whole_lines(file, size: int) -> int:
    """Where the last whole line of the first ``size`` bytes ends."""
    while size > 0:
        low = max(0, size - BLOCK_BYTES)
        found = file.read_at(size - low, low).rfind(NEWLINE)
        if found >= 0:
            return low + found + 1
        size = low
    return 0


def lines_in(file, part: LineRange) -> Iterator[tuple[int, bytes]]:
    """Start and bytes (without the end) of the lines of a range."""
    at = part.low
    if at > part.first:  # a line that began before belongs to the range before
        at -= 1
        while True:
            block = file.read_at(min(BLOCK_BYTES, part.end - at), at)
            found = block.find(NEWLINE)
            if found >= 0:
                at += found + 1
                break
            at += len(block)
    while at < part.high:
        block = file.read_at(min(BLOCK_BYTES, part.end - at), at)
        while (cut := block.rfind(NEWLINE)) < 0:
            block += file.read_at(min(BLOCK_BYTES, part.end - at - len(block)), at + len(block))
        for line in block[:cut].split(NEWLINE):
            if at >= part.high:
                return
            yield at, line
            at += len(line) + 1


class TailReader(DataSourceStreamReader):
    """Offsets are ``{"files": {path: bytes}}``; they grow with the number of files, not of lines.

    A file that is shorter than its offset was replaced and is read from its start. A file that is
    gone keeps its offset."""

    def __init__(self, path: str, pattern: str, range_bytes: int):
        self.path, self.pattern, self.range_bytes = path, pattern, range_bytes
        self.known: dict[str, tuple[int, int]] = {}  # size when looked at, end of whole lines

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def _files(self) -> Iterator[tuple[str, int]]:
        system, root = self._system()
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        for item in found:
            if item.type == fs.FileType.File and fnmatch.fnmatch(PurePosixPath(item.path).name, self.pattern):
                yield item.path, item.size

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, _ = self._system()
        for path, size in self._files():
            if self.known.get(path, (None, 0))[0] != size:
                with system.open_input_file(path) as file:
                    self.known[path] = size, whole_lines(file, size)
        return {"files": {path: end for path, (_, end) in sorted(self.known.items())}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, upto in end["files"].items():
            first = start["files"].get(path, 0)
            first = 0 if first > upto else first
            edges = [*range(first, upto, self.range_bytes), upto]
            out += [LineRange(path, a, b, first, upto) for a, b in zip(edges, edges[1:])]
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("value", pa.string())])

        def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            texts = [line.decode("utf-8", "replace").removesuffix("\r") for _, line in rows]
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array([a for a, _ in rows], pa.int64()), pa.array(texts, pa.string())], schema=schema)

        with system.open_input_file(partition.path) as file:
            rows = []
            for row in lines_in(file, partition):
                rows.append(row)
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiretide_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        options = self.options
        return TailReader(options["path"], options.get("pattern", "*"), int(options.get("rangeBytes", RANGE_BYTES)))


def tail_text(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines as they are appended to a file or to the files of a folder: ``path``, ``start`` (the
    byte at which the line begins) and ``value``. The folder must be one that the driver and all
    executors reach by the same name: a mounted one, or one that Arrow's file systems open."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("wiretide_tail").options(path=path, pattern=pattern, rangeBytes=range_bytes).load()


def tail_hexdump(spark: SparkSession, path: str, pattern: str = "*", capture_id: Column | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Growing hexdump logs as lines for ``parse_lines``, in the order of their bytes."""
    name = F.col("path") if capture_id is None else capture_id
    lines = tail_text(spark, path, pattern, range_bytes)
    return lines.select(name.alias("capture_id"), "path", F.lit(0).cast("bigint").alias("block"), F.col("start").alias("line"), "value")


def tail_json(spark: SparkSession, path: str, schema: str | Mapping, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Growing NDJSON files as records of ``schema``; lines that are no such records are skipped."""
    record = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    lines = tail_text(spark, path, pattern, range_bytes).where(F.trim("value").startswith("{"))
    return lines.select(record.alias("r")).where(F.col("r").isNotNull()).select("r.*")
