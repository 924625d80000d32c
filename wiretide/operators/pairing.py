"""Requests and their responses."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.functions.scalar import micros
from wiretide.functions.binary import u16
from wiretide.operators.folds import Step, fold
from wiretide.operators.framing import (
    EXCEPTION,
    READ_HOLDING,
    READ_INPUT,
    REQUEST,
    RESPONSE,
    sane_read,
)
from wiretide.operators.runs import Run, run

_FRAME = ("off", "ts", "raw", "role", "device", "fc")


def pair_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    opens: Column,
    answer: dict[str, Column],
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Rows for which ``opens`` holds, with the ``answer`` columns of the very next row."""
    nxt = run(df, keys, order, rows_per_cut).lead(answer).done()
    return nxt.where(opens)


def pair_run(
    frames: DataFrame | Run,
    keys: Sequence[str] = ("capture_id",),
    exceptions: bool = False,
    rows_per_cut: int | None = None,
) -> Run:
    """:func:`pair_frames` as a run ordered by ``pair_off``. Frames that are laid out keep their
    layout, and so do the pairs."""
    laid = run(frames, keys, ["off"], rows_per_cut)
    slim = laid.select(*keys, *_FRAME)
    led = slim.lead({"rsp": F.struct(*[F.col(c) for c in _FRAME])})
    codes = F.col("rsp.fc") == F.col("fc")
    if exceptions:
        codes = codes | (F.col("rsp.fc") == F.col("fc").bitwiseOR(F.lit(EXCEPTION)))
    hit = led.where(
        (F.col("role") == REQUEST)
        & (F.col("rsp.role") == RESPONSE)
        & (F.col("rsp.device") == F.col("device"))
        & codes
    )
    return hit.select(
        *keys,
        F.col("off").alias("pair_off"),
        "device",
        "fc",
        F.col("rsp.fc").alias("rsp_fc"),
        F.col("ts").alias("req_ts"),
        F.col("rsp.ts").alias("rsp_ts"),
        F.col("raw").alias("req_raw"),
        F.col("rsp.raw").alias("rsp_raw"),
        u16("raw", 2).alias("addr"),
        F.when(F.col("fc").isin(READ_HOLDING, READ_INPUT), u16("raw", 4)).alias("count"),
        order=["pair_off"],
    )


def pair_frames(
    frames: DataFrame | Run,
    keys: Sequence[str] = ("capture_id",),
    exceptions: bool = False,
    rows_per_cut: int | None = None,
) -> DataFrame:
    """A request and the next frame, if that answers it: same device and function code,
    or (with ``exceptions``) the request's code with the exception bit set."""
    return pair_run(frames, keys, exceptions, rows_per_cut).done()


class PendingQueue(Step):
    """Open read requests, oldest first, at most ``limit``. A response takes the first
    one with its device, function code and data length; a request that finds the queue
    full pushes the oldest out. Other frames pass through."""

    output = (
        "req_off bigint, req_us bigint, rsp_off bigint, rsp_us bigint, device int, fc int, "
        "addr int, count int"
    )
    needs = ("off", "us", "role", "device", "fc", "len", "addr", "count")

    def __init__(self, limit: int = 32, fc4_layout: str = "echo"):
        self.limit = limit
        self.overhead = {READ_HOLDING: 5, READ_INPUT: 6 if fc4_layout == "echo" else 5}

    def start(self) -> Any:
        return []

    def feed(self, state: Any, rows: pd.DataFrame, base: int):
        queue = [list(entry) for entry in state]
        found = []
        for off, us, role, device, fc, size, addr, count in zip(
            *(rows[c] for c in self.needs)
        ):
            device, fc, size = int(device), int(fc), int(size)
            if fc not in self.overhead or not 1 <= device <= 247:
                continue
            if role == REQUEST:
                if 1 <= count <= 125:
                    queue = queue[-(self.limit - 1) :] if len(queue) >= self.limit else queue
                    queue.append([int(off), int(us), device, fc, int(addr), int(count)])
                continue
            for pos, (r_off, r_us, r_device, r_fc, r_addr, r_count) in enumerate(queue):
                if r_device == device and r_fc == fc and size == 2 * r_count + self.overhead[fc]:
                    found.append((r_off, r_us, int(off), int(us), device, fc, r_addr, r_count))
                    del queue[pos]
                    break
        names = [part.split()[0] for part in self.output.split(", ")]
        return pd.DataFrame(found, columns=names), queue


def _queue_rows(frames: DataFrame | Run, keys: Sequence[str]) -> DataFrame | Run:
    request, schema = F.col("role") == REQUEST, (frames.df if isinstance(frames, Run) else frames).schema
    return frames.select(
        *keys,
        "off",
        micros(F.col("ts"), schema["ts"].dataType).alias("us"),
        "role",
        "device",
        "fc",
        "len",
        F.when(request, u16("raw", 2)).otherwise(0).alias("addr"),
        F.when(request, u16("raw", 4)).otherwise(0).alias("count"),
    )


def pair_pending(
    frames: DataFrame | Run,
    keys: Sequence[str] = ("capture_id",),
    limit: int = 32,
    fc4_layout: str = "echo",
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Pair through a queue of open requests, so answers may come late or out of order."""
    laid = run(frames, keys, ["off"], rows_per_cut)
    return fold(_queue_rows(laid, keys), keys, ["off"], PendingQueue(limit, fc4_layout), rows_per_cut)


def pair_latest(
    frames: DataFrame | Run,
    keys: Sequence[str] = ("capture_id",),
    fc4_layout: str = "echo",
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Pair with the newest valid read request only; the first matching response uses it up."""
    opens = (F.col("role") == REQUEST) & F.col("fc").isin(READ_HOLDING, READ_INPUT) & sane_read()
    ask = F.when(
        opens,
        F.struct(
            F.col("off").alias("off"),
            F.col("ts").alias("ts"),
            F.col("device").alias("device"),
            F.col("fc").alias("fc"),
            u16("raw", 2).alias("addr"),
            u16("raw", 4).alias("count"),
        ),
    )
    slim = run(frames, keys, ["off"], rows_per_cut).select(*keys, "off", "ts", "raw", "role", "device", "fc", "len")
    held = slim.last_known({"ask": ask})
    overhead = F.when((F.col("fc") == READ_INPUT) & F.lit(fc4_layout == "echo"), 6).otherwise(5)
    hit = held.where(
        (F.col("role") == RESPONSE)
        & (F.col("ask.device") == F.col("device"))
        & (F.col("ask.fc") == F.col("fc"))
        & (F.col("len") == 2 * F.col("ask.count") + overhead)
    )
    # Answers to one request follow each other, so those after the first see it used before them.
    told = hit.select(*keys, "off", "ts", "ask").lag({"__used": F.col("ask.off")}).done()
    first = told.where(~F.col("__used").eqNullSafe(F.col("ask.off")))
    return first.select(
        *keys,
        F.col("ask.off").alias("req_off"),
        F.col("ask.ts").alias("req_ts"),
        F.col("off").alias("rsp_off"),
        F.col("ts").alias("rsp_ts"),
        F.col("ask.device").alias("device"),
        F.col("ask.fc").alias("fc"),
        F.col("ask.addr").alias("addr"),
        F.col("ask.count").alias("count"),
    )
