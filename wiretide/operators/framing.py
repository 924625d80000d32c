"""Bytes to checked frames: a resynchronising request/response walk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import timedelta
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.functions.binary import crc16_bytes, crc16_many, u16
from wiretide.operators.folds import Step, fold_run
from wiretide.operators.runs import Run, materialise

REQUEST, RESPONSE = "request", "response"
READ_HOLDING, READ_INPUT, WRITE_SINGLE, EXCEPTION = 3, 4, 6, 0x80
#: CRCs of longer slices are not computed beforehand.
LONGEST = 260


class Exchanges(NamedTuple):
    """Where a request with a good CRC begins a chunk and an answer with a good CRC follows it at once: a walk
    that expects a request there takes both. Each comes with its answer's size and the end of the
    exchanges that follow it without a gap (``till``)."""

    at: np.ndarray
    size: np.ndarray
    till: np.ndarray


NONE = Exchanges(*[np.zeros(0, np.int64)] * 3)


class FrameWalk(Step):
    """Frame decisions along one byte stream.

    A frame is tried in the expected role first, then in the other one; if neither has a
    good CRC the first byte is dropped. A read request leaves its word count for the
    next frame, since an echo-style input response does not carry its own length. The
    walk waits when a candidate reaches past the bytes seen so far and resolves it in
    :meth:`finish`. State: undecided bytes and their times, the expected role, the open
    count, and the bytes dropped since the last frame.

    Whole exchanges that begin where a chunk does are found together beforehand (:class:`Exchanges`); the
    walk takes any number of them in one step and decides the rest frame by frame, so they only save time.
    """

    output = (
        "off bigint, us bigint, raw binary, role string, device int, fc int, len int, "
        "swap boolean, gap bigint"
    )
    needs = ("us", "bytes")
    places = ("off",)
    forgets = True

    def __init__(self, fc4_layout: str = "echo"):
        if fc4_layout not in ("echo", "standard"):
            raise ValueError(f"fc4_layout must be 'echo' or 'standard', got {fc4_layout!r}")
        self.echo = fc4_layout == "echo"

    def start(self) -> Any:
        return {"tail": "", "times": [], "role": REQUEST, "open": None, "gap": 0}

    def weight(self, rows: pd.DataFrame) -> int:
        return int(sum(map(len, rows["bytes"])))

    def feed(self, state: Any, rows: pd.DataFrame, base: int):
        tail = bytes.fromhex(state["tail"])
        chunks = rows["bytes"].tolist()
        buf = b"".join([tail, *chunks])
        sizes = [n for _, n in state["times"]] + [len(c) for c in chunks]
        us = rows["us"]
        if us.dtype.kind == "M":
            us = us.astype("datetime64[us]").astype("int64")
        times = [t for t, _ in state["times"]] + us.tolist()
        ends = np.cumsum(np.array(sizes, dtype=np.int64))
        stamps = np.array(times, dtype=np.int64)
        whole = self._exchanges(np.frombuffer(buf, np.uint8), np.unique(np.r_[0, ends[:-1]]))
        frames, used, role, open_count, gap = self._walk(
            buf, state["role"], state["open"], state["gap"], False, whole
        )
        left = []
        if used < len(buf):
            first = int(np.searchsorted(ends, used, side="right"))
            left = [[int(stamps[p]), int(ends[p] - max(used, ends[p] - sizes[p]))] for p in range(first, len(sizes))]
            left = [pair for pair in left if pair[1]]
        after = {"tail": buf[used:].hex(), "times": left, "role": role, "open": open_count, "gap": gap}
        return self._rows(frames, buf, ends, stamps, base - len(tail)), after

    def finish(self, state: Any, base: int) -> pd.DataFrame:
        """Decide the remaining bytes, then add one row without role that carries the
        bytes dropped after the last frame."""
        buf = bytes.fromhex(state["tail"])
        ends = np.cumsum(np.array([n for _, n in state["times"]], dtype=np.int64))
        stamps = np.array([t for t, _ in state["times"]], dtype=np.int64)
        frames, _, _, _, gap = self._walk(buf, state["role"], state["open"], state["gap"], True)
        rows = self._rows(frames, buf, ends, stamps, base - len(buf))
        end = dict.fromkeys(rows.columns) | {"off": base, "gap": gap}
        return pd.DataFrame([*rows.to_dict("records"), end], columns=rows.columns, dtype=object)

    @staticmethod
    def _rows(frames, buf, ends, stamps, origin) -> pd.DataFrame:
        starts, size, answers, swap, gap = frames
        data = np.frombuffer(buf, np.uint8)
        return pd.DataFrame(
            {
                "off": starts + origin,
                "us": stamps[np.searchsorted(ends, starts, side="right")],
                "raw": [buf[s : s + n] for s, n in zip(starts.tolist(), size.tolist())],
                "role": np.array([REQUEST, RESPONSE], object)[answers],
                "device": data[starts],
                "fc": data[starts + 1],
                "len": size,
                "swap": swap,
                "gap": gap,
            }
        )

    def _exchanges(self, data: np.ndarray, at: np.ndarray) -> Exchanges:
        """The exchanges that begin at some of the sorted places ``at``."""
        at = at[at + 12 <= len(data)]
        at = at[np.isin(data[at + 1], [READ_HOLDING, READ_INPUT, WRITE_SINGLE])]
        at = at[_sealed(data, at, np.full(len(at), 8))]
        fc, asked = data[at + 9], (data[at + 4].astype(np.int64) << 8) | data[at + 5]
        echo = np.where(data[at + 1] == WRITE_SINGLE, 0, 6 + 2 * asked)
        plain = np.where(fc == WRITE_SINGLE, 8, np.where(fc & EXCEPTION, 5, 0))
        sized = (fc == READ_HOLDING) | ((fc == READ_INPUT) & (not self.echo))
        size = np.where(sized, 5 + data[at + 10].astype(np.int64), np.where(fc == READ_INPUT, echo, plain))
        kept = (size >= 4) & (size <= LONGEST) & (at + 8 + size <= len(data))
        at, size = at[kept], size[kept]
        kept = _sealed(data, at + 8, size)
        at, size = at[kept], size[kept]
        if not len(at):
            return NONE
        last = np.flatnonzero(np.r_[at[1:] != at[:-1] + 8 + size[:-1], True])
        return Exchanges(at, size, last[np.searchsorted(last, np.arange(len(at)))] + 1)

    def _size(self, role: str, buf: bytes, at: int, open_count: int | None) -> int | None:
        """Frame length a role would have here, or None if it cannot start here."""
        fc = buf[at + 1]
        if role == REQUEST:
            return 8 if fc in (READ_HOLDING, READ_INPUT, WRITE_SINGLE) else None
        if fc == READ_HOLDING or (fc == READ_INPUT and not self.echo):
            return 5 + buf[at + 2]
        if fc == READ_INPUT:
            return None if open_count is None else 6 + 2 * open_count
        if fc == WRITE_SINGLE:
            return 8
        return 5 if fc & EXCEPTION else None

    @staticmethod
    def _next(role: str, buf: bytes, at: int) -> tuple[str, int | None]:
        """Expected role and open count after a frame."""
        if role == RESPONSE:
            return REQUEST, None
        if buf[at + 1] in (READ_HOLDING, READ_INPUT):
            return RESPONSE, (buf[at + 4] << 8) | buf[at + 5]
        return RESPONSE, None

    def _walk(self, buf, role, open_count, gap, final, whole=NONE):
        frames: list[tuple[int, int, bool, bool, int]] = []
        taken_whole: list[tuple[int, int, int]] = []
        index, till = dict(zip(whole.at.tolist(), range(len(whole.at)))), whole.till.tolist()
        size, at, waits = len(buf), 0, False
        while size - at >= 4 and not waits:
            first = index.get(at) if role == REQUEST else None
            if first is not None:
                taken_whole.append((first, till[first], gap))
                at = int(whole.at[till[first] - 1] + 8 + whole.size[till[first] - 1])
                open_count, gap = None, 0
                continue
            taken = None
            for attempt in (role, RESPONSE if role == REQUEST else REQUEST):
                n = self._size(attempt, buf, at, open_count)
                if n is None:
                    continue
                end = at + n
                if end > size:
                    if final:
                        continue
                    waits = True
                    break
                if crc16_bytes(buf[at : end - 2]) == buf[end - 2] | (buf[end - 1] << 8):
                    taken = attempt
                    break
            if waits:
                break
            if taken is None:
                gap += 1
                at += 1
                continue
            frames.append((at, n, taken == RESPONSE, taken != role, gap))
            gap = 0
            role, open_count = self._next(taken, buf, at)
            at = end
        return _in_order(frames, taken_whole, whole), at, role, open_count, gap


def _sealed(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the CRCs of frames are good."""
    last = at + size
    return crc16_many(data, at, size - 2) == (data[last - 2] | (data[last - 1].astype(np.uint16) << 8))


def _in_order(frames: list[tuple], taken: list[tuple[int, int, int]], whole: Exchanges) -> tuple[np.ndarray, ...]:
    """Start, size, whether an answer, swap and gap of all frames: those decided one by one, and those of the
    ranges of exchanges that were taken whole."""
    one = np.array(frames, np.int64).reshape(-1, 5)
    low, high, before = np.array(taken, np.int64).reshape(-1, 3).T
    n = high - low
    first = np.cumsum(n) - n
    rows = np.repeat(low - first, n) + np.arange(n.sum())
    asks, answers = np.zeros((2, len(rows), 5), np.int64)
    asks[:, 0], asks[:, 1], asks[first, 4] = whole.at[rows], 8, before
    answers[:, 0], answers[:, 1], answers[:, 2] = whole.at[rows] + 8, whole.size[rows], 1
    every = np.concatenate([one, asks, answers])
    start, size, answer, swap, gap = every[np.argsort(every[:, 0], kind="stable")].T
    return start, size, answer, swap.astype(bool), gap


def _walked(chunks: DataFrame | Run, keys: Sequence[str], order: Sequence[str], fc4_layout: str, rows_per_cut: int | None) -> Run:
    # Arrow holds times as microseconds, so they go to Python as they are.
    slim = chunks.select(*keys, *order, F.col("ts").cast("timestamp_ntz").alias("us"), "bytes")
    # Laid out chunks are read once, others also to be cut.
    slim = slim if isinstance(slim, Run) else materialise(slim)
    walked = fold_run(slim, keys, order, FrameWalk(fc4_layout), ["off"], rows_per_cut)
    timed = walked.with_columns({"ts": micros_to_ntz(F.col("us"))})
    return replace(timed, df=timed.df.drop("us"))


def frame_run(
    chunks: DataFrame | Run,
    keys: Sequence[str] = ("capture_id",),
    order: Sequence[str] = ("path", "block", "line"),
    fc4_layout: str = "echo",
    rows_per_cut: int | None = None,
) -> Run:
    """:func:`walk_frames` laid out by capture and offset: the frames keep the cuts of their log
    lines and are stored once, so all later steps on a capture share one layout."""
    walked = _walked(chunks, keys, order, fc4_layout, rows_per_cut)
    return walked if walked.dealt else walked.store()  # what is walked in cuts is stored already


def walk_frames(
    chunks: DataFrame | Run,
    keys: Sequence[str] = ("capture_id",),
    order: Sequence[str] = ("path", "block", "line"),
    fc4_layout: str = "echo",
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Frames of every capture plus one closing row (no role) with the trailing drops.
    ``chunks`` has ``ts TIMESTAMP_NTZ`` and ``bytes BINARY`` per log line. Chunks that are not laid
    out are stored first, since cutting and walking read them again."""
    return _walked(chunks, keys, order, fc4_layout, rows_per_cut).done()


def micros_to_ntz(us: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + us * F.lit(timedelta(microseconds=1))


def frames_only(walked: DataFrame | Run) -> DataFrame | Run:
    return walked.where(F.col("role").isNotNull())


def read_request(raw: Column | str) -> tuple[Column, Column]:
    """Start register and count (or value, for a write) words of a request."""
    return u16(raw, 2), u16(raw, 4)


def sane_read() -> Column:
    """Device and count of a read request are in the ranges a master may use."""
    _, count = read_request("raw")
    return F.col("device").between(1, 247) & count.between(1, 125)
