"""Whole jobs: log to report inputs, log to register state, three streams to one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from wiretide.functions.scalar import local_to_utc
from wiretide.operators.asof import join_streams
from wiretide.operators.decode import key_registers, wire_table
from wiretide.operators.framing import frame_run, frames_only, walk_frames
from wiretide.operators.pairing import pair_frames, pair_run
from wiretide.operators.registers import field_columns, parse_spec, register_state
from wiretide.operators.runs import Run
from wiretide.plans.report import report
from wiretide.sources.hexdump import LINE_ORDER, parse_lines, read_hexdump


def framed(lines: DataFrame | Run, order: Sequence[str] = LINE_ORDER, fc4_layout: str = "echo",
           rows_per_cut: int | None = None) -> Run:
    """Walked frames (with closing rows) of raw log lines, laid out and stored once: framing is the
    costly step, and every later step on a capture goes on from this layout."""
    return frame_run(parse_lines(lines), order=order, fc4_layout=fc4_layout, rows_per_cut=rows_per_cut)


def frames_from_lines(lines: DataFrame | Run, order: Sequence[str] = LINE_ORDER, fc4_layout: str = "echo",
                      rows_per_cut: int | None = None) -> DataFrame:
    """:func:`framed` as plain rows, for one reader: they are not laid out again."""
    return walk_frames(parse_lines(lines), order=order, fc4_layout=fc4_layout, rows_per_cut=rows_per_cut)


def capture_report(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, DataFrame]:
    walked = frame_run(read_hexdump(spark, paths))
    return report(walked, pair_run(frames_only(walked)))


def register_state_table(
    spark: SparkSession, paths: str | Sequence[str], specs: Sequence[str] | None = None,
    min_gap_seconds: float = 0.0,
) -> tuple[DataFrame, list[str]]:
    """State rows and their column names, from logs."""
    if min_gap_seconds < 0:
        raise ValueError("min_gap_seconds must be >= 0")
    return state_table(frame_run(read_hexdump(spark, paths)), specs, min_gap_seconds)


def state_table(walked: Run, specs: Sequence[str] | None = None, min_gap_seconds: float = 0.0) -> tuple[DataFrame, list[str]]:
    """State rows of framed captures, and their columns: those of all registers that occur, or of
    the registers that ``specs`` name."""
    pairs = pair_run(frames_only(walked), exceptions=True).store()
    parsed = None if specs is None else [parse_spec(s) for s in specs]
    columns = field_columns(key_registers(pairs.done()), parsed)
    return register_state(pairs, columns, min_gap_seconds=min_gap_seconds), [c.name for c in columns]


def wire_from_logs(
    spark: SparkSession, paths: str | Sequence[str], wire_tz: str | Column = "UTC", strict_start: bool = False
) -> DataFrame:
    """Decoded wire rows; the logger's local wall clock becomes an instant."""
    wire = wire_table(pair_frames(frames_only(frame_run(read_hexdump(spark, paths)))), strict_start=strict_start)
    return wire.withColumn("ts", local_to_utc(wire["ts"], wire_tz))


def joined_table(
    wire: DataFrame, polls: DataFrame | None, tags: DataFrame | None, by: Sequence[str] = ("capture_id",),
    seq: Mapping[str, str] | None = None,
) -> DataFrame:
    """Wire rows with poll fields and active tag. Nothing is lost when a side is empty."""
    return join_streams(wire, polls, tags, by=by, seq=dict(seq or {"wire": "pair_off"}))
