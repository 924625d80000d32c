"""Stateful steps on streams: the batch rules, driven from a state store.

Each processor keeps one key's state and needs the RocksDB state store provider
(:func:`use_rocksdb`). Rows of a key are put in order inside a micro-batch; across
micro-batches arrival order counts, as it does on the wire.

Keys that fall silent lose their state in one of two ways. ``ttl_ms`` counts processing time, so
use it with a trigger that keeps running (an available-now query with it does not end by itself).
``idle`` counts event time: once the watermark has passed a key's newest row by that much, the step
finishes as at the end of a capture, gives what it still holds, and forgets the key. Rows behind
the watermark are dropped by Spark; :func:`mark_late` marks them per key beforehand, so that they
can be written elsewhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from wiretide.functions.scalar import micros, ntz_micros
from wiretide.operators.folds import Step
from wiretide.operators.framing import FrameWalk, micros_to_ntz
from wiretide.operators.pairing import PendingQueue, _queue_rows
from wiretide.operators.throttle import MinGap

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@dataclass(frozen=True)
class Idle:
    """Event-time expiry: the timestamp column, how far rows may lag behind the newest one of the
    stream, and how long a key may be silent, both in milliseconds."""

    ts: str
    delay_ms: int
    idle_ms: int


EVENT_MS = "event_ms"


class StepProcessor(StatefulProcessor):
    """Any :class:`Step` on a stream."""

    def __init__(self, step: Step, keys: Sequence[str], order: Sequence[str], schema: StructType, ttl_ms: int | None, idle_ms: int | None = None):
        self.step = step
        self.keys = list(keys)
        self.order = list(order)
        self.columns = schema.names
        self.ttl_ms = ttl_ms
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("step", "state string, base bigint, newest bigint", self.ttl_ms)

    def _rows(self, key: Any, out: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        if out is not None and len(out):
            fixed = pd.DataFrame({k: [v] * len(out) for k, v in zip(self.keys, key)})
            own = [c for c in self.columns if c not in self.keys]
            yield pd.concat([fixed, out[own].reset_index(drop=True)], axis=1)[self.columns]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = list(rows)  # bounded by the source's per-trigger limit
        batch = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        batch = batch.sort_values(self.order, kind="stable", ignore_index=True)
        held = self.state.get() if self.state.exists() else None
        if held and self.idle_ms is not None and timerValues.getCurrentWatermarkInMs() >= int(held[2]) + self.idle_ms:
            # the key speaks again in the very batch in which it would have been closed
            yield from self._rows(key, self.step.finish(json.loads(held[0]), int(held[1])))
            held = None
        state = json.loads(held[0]) if held else self.step.start()
        base, newest = (int(held[1]), int(held[2])) if held else (0, 0)
        out, state = self.step.feed(state, batch, base)
        if self.idle_ms is not None:
            newest = max(newest, int(batch[EVENT_MS].max()))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.idle_ms)
        self.state.update((json.dumps(state, sort_keys=True), base + self.step.weight(batch), newest))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            held = self.state.get()
            self.state.clear()
            yield from self._rows(key, self.step.finish(json.loads(held[0]), int(held[1])))

    def close(self) -> None:
        pass


def stream_step(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, ttl_ms: int | None = None, idle: Idle | None = None,
) -> DataFrame:
    schema = StructType([*[df.schema[k] for k in keys], *StructType.fromDDL(step.output).fields])
    if idle:
        if ttl_ms:
            raise ValueError("state expires by ttl_ms or by idle, not by both")
        df = df.withWatermark(idle.ts, f"{idle.delay_ms} milliseconds").withColumn(EVENT_MS, F.unix_millis(idle.ts))
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=StepProcessor(step, keys, order, schema, ttl_ms, idle.idle_ms if idle else None),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime" if idle else "ProcessingTime" if ttl_ms else "None",
    )


class LateMark(StatefulProcessor):
    """Whether a row lags behind the newest row of its key, as seen before its micro-batch."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.newest.get()[0] if self.newest.exists() else None
        newest = known
        for batch in rows:
            late = batch[EVENT_MS] < known - self.delay_ms if known is not None else pd.Series(False, index=batch.index)
            newest = int(max(batch[EVENT_MS].max(), newest if newest is not None else batch[EVENT_MS].max()))
            yield batch.drop(columns=EVENT_MS).assign(late=late.to_numpy())
        self.newest.update((newest,))

    def close(self) -> None:
        pass


def mark_late(df: DataFrame, keys: Sequence[str], ts: str, delay_ms: int) -> DataFrame:
    """``df`` with ``late``: the row is older, by more than the delay, than what an earlier
    micro-batch held of its key. Write the late ones to a table of their own and give the rest to
    a step; a key that is slow as a whole is not late, as it would be by a watermark of the stream."""
    schema = StructType([*df.schema.fields]).add("late", "boolean")
    return df.withColumn(EVENT_MS, F.unix_millis(ts)).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=LateMark(delay_ms), outputStructType=schema, outputMode="Append", timeMode="None")


def stream_frames(
    chunks: DataFrame, keys: Sequence[str] = ("capture_id",), order: Sequence[str] = ("path", "block", "line"),
    fc4_layout: str = "echo", ttl_ms: int | None = None, idle: Idle | None = None,
) -> DataFrame:
    """Frames as bytes arrive; an incomplete tail waits for its next chunk. A capture that is
    ``idle`` is closed: its tail is decided and its closing row (no role) comes out."""
    micros = ntz_micros(F.col("ts").cast("timestamp_ntz"))
    event = [F.col(idle.ts).cast("timestamp").alias(idle.ts)] if idle else []
    slim = chunks.select(*keys, *order, micros.alias("us"), "bytes", *event)
    walked = stream_step(slim, keys, order, FrameWalk(fc4_layout), ttl_ms, idle)
    return walked.withColumn("ts", micros_to_ntz(F.col("us"))).drop("us")


def stream_pending(
    frames: DataFrame, keys: Sequence[str] = ("capture_id",), limit: int = 32, fc4_layout: str = "echo",
    ttl_ms: int | None = None,
) -> DataFrame:
    """Pairing through a queue of open requests."""
    return stream_step(_queue_rows(frames, keys), keys, ["off"], PendingQueue(limit, fc4_layout), ttl_ms)


def stream_min_gap(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, gap_seconds: float,
    data: Sequence[str] = (), ttl_ms: int | None = None,
) -> DataFrame:
    """Rate limit (no ``data``) or de-duplication with a minimum gap. Returns the keys,
    order and ``data`` columns of kept rows."""
    packed = F.to_json(F.struct(*data), {"ignoreNullFields": "false"}) if data else F.lit(None).cast("string")
    carried = [*order, *[d for d in data if d not in order]]
    slim = df.select(
        *keys, *carried, micros(F.col(ts), df.schema[ts].dataType).alias("at_us"), packed.alias("packed_data")
    )
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    step = MinGap(round(gap_seconds * 1_000_000), bool(data), ddl)
    return stream_step(slim, keys, order, step, ttl_ms)


class ChangeStep(Step):
    """Change detection on one field; records without it are not readings."""

    def __init__(self, field: str, ts: str, kind: str, ts_kind: str):
        self.field, self.ts = field, ts
        self.needs = [ts, field]
        self.output = f"`{ts}` {ts_kind}, prev_value {kind}, new_value {kind}"

    def start(self) -> Any:
        return None

    def feed(self, state: Any, rows: pd.DataFrame, base: int):
        present = rows[rows[self.field].notna()]
        values = present[self.field].tolist()
        before = [state, *values[:-1]] if values else []
        hit = [p is not None and p != v for p, v in zip(before, values)]
        out = pd.DataFrame(
            {
                self.ts: present[self.ts][hit].tolist(),
                "prev_value": [p for p, h in zip(before, hit) if h],
                "new_value": [v for v, h in zip(values, hit) if h],
            }
        )
        return out, values[-1] if values else state


def stream_changes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], field: str, ts: str = "ts", ttl_ms: int | None = None
) -> DataFrame:
    slim = df.select(*keys, *dict.fromkeys([*order, ts, field]))
    step = ChangeStep(field, ts, df.schema[field].dataType.simpleString(), df.schema[ts].dataType.simpleString())
    return stream_step(slim, keys, order, step, ttl_ms)


def stream_auto_tags(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], field: str, ts: str = "ts", ttl_ms: int | None = None
) -> DataFrame:
    """Changes as tag events."""
    text = F.format_string(f"auto:{field}:%s->%s", F.col("prev_value").cast("string"), F.col("new_value").cast("string"))
    found = stream_changes(df, keys, order, field, ts, ttl_ms)
    return found.select(*keys, ts, text.alias("tag"), F.lit("auto").alias("source"))


class LastKnown(StatefulProcessor):
    """Live register image: a map ``(device, fc, reg) -> value`` per key. Emits each
    register whose value is new or changed, once per micro-batch."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], ttl_ms: int | None):
        self.keys, self.order, self.ttl_ms = list(keys), list(order), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("registers", "device int, fc int, reg int", "value int", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        latest = batch.drop_duplicates(["device", "fc", "reg"], keep="last")
        out = []
        for device, fc, reg, value in zip(*(latest[c] for c in ("device", "fc", "reg", "value"))):
            slot = (int(device), int(fc), int(reg))
            known = self.held.getValue(slot) if self.held.containsKey(slot) else None
            if known is None or known[0] != int(value):
                self.held.updateValue(slot, (int(value),))
                out.append((*key, *slot, int(value)))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "device", "fc", "reg", "value"])

    def close(self) -> None:
        pass


def stream_last_known(
    registers: DataFrame, keys: Sequence[str] = ("capture_id",), order: Sequence[str] = ("pair_off",),
    ttl_ms: int | None = None,
) -> DataFrame:
    slim = registers.select(*keys, *order, "device", "fc", "reg", "value")
    image = StructType.fromDDL("device int, fc int, reg int, value int")
    schema = StructType([*[slim.schema[k] for k in keys], *image.fields])
    return slim.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=LastKnown(keys, order, ttl_ms),
        outputStructType=schema,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
