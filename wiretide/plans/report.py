"""Capture report: totals, frame summary, cadence, latency, coverage, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.binary import u8, u16
from wiretide.functions.scalar import duration_ms
from wiretide.operators.changes import gap_summary, gap_us, islands
from wiretide.operators.framing import EXCEPTION, READ_HOLDING, READ_INPUT, REQUEST, WRITE_SINGLE, frames_only
from wiretide.operators.runs import Run, rows_of, run
from wiretide.operators.stats import with_quantiles

KEYS = ("capture_id",)
QUERY = ("device", "fc", "addr", "count")


def capture_totals(walked: DataFrame, pairs: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frames, dropped bytes, first-to-last span and pairs per capture. Partial counts
    are combined before the shuffle."""
    framed = F.col("role").isNotNull()
    first = F.min_by(F.when(framed, F.col("ts")), F.when(framed, F.col("off")))
    last = F.max_by(F.when(framed, F.col("ts")), F.when(framed, F.col("off")))
    span = F.coalesce(duration_ms(first, last) / 1000, F.lit(0.0))
    totals = walked.groupBy(*keys).agg(
        F.count_if(framed).alias("frames"), F.sum("gap").alias("drops"), span.alias("span_seconds")
    )
    if pairs is None:
        return totals
    counted = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"))
    return totals.join(counted, list(keys), "left").fillna(0, ["pairs"])


def frame_summary(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return frames.groupBy(*keys, "role", "fc").agg(F.count("*").alias("n"))


def cadence(pairs: DataFrame | Run, keys: Sequence[str] = KEYS, rows_per_cut: int | None = None) -> DataFrame:
    """Gap between consecutive requests of the same read query. Pairs that are laid out by capture
    keep that layout: queries divide its cuts."""
    reads = pairs.where(F.col("fc").isin(READ_HOLDING, READ_INPUT))
    by = [*keys, *QUERY]
    gaps = gap_us(reads.select(*by, "pair_off", "req_ts"), by, ["pair_off"], "req_ts", "gap_us", rows_per_cut)
    return gap_summary(gaps, by)


def latency(
    pairs: DataFrame | Run, keys: Sequence[str] = KEYS, probabilities: dict[str, float] | None = None,
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Response time per query; writes are grouped by device and function code only."""
    read = F.col("fc").isin(READ_HOLDING, READ_INPUT)
    timed = pairs.select(
        *keys, "device", "fc",
        F.when(read, F.col("addr")).alias("addr"), F.when(read, F.col("count")).alias("count"),
        duration_ms(F.col("req_ts"), F.col("rsp_ts")).alias("ms"), "pair_off",
    )
    timed = rows_of(timed.store() if isinstance(timed, Run) else timed)  # read for counts and for ranks
    aggregates = [
        F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"), F.min("pair_off").alias("first_pair_off"),
    ]
    return with_quantiles(
        timed, [*keys, *QUERY], "ms", aggregates, probabilities or {"p50": 0.5, "p95": 0.95}, rows_per_cut
    )


def top_queries(latencies: DataFrame, keys: Sequence[str] = KEYS, top: int = 30) -> DataFrame:
    """Most frequent queries per capture; ties in order of appearance."""
    rank = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("first_pair_off"))
    return latencies.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)


def _first(frames: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy("off")
    return frames.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def writes(frames: DataFrame, keys: Sequence[str] = KEYS, top: int = 20) -> DataFrame:
    """First write requests per capture. Spark limits each task before the shuffle."""
    found = frames.where((F.col("fc") == WRITE_SINGLE) & (F.col("role") == REQUEST))
    return _first(found, keys, top).select(
        *keys, "rank", "ts", "device", u16("raw", 2).alias("addr"), u16("raw", 4).alias("value")
    )


def exceptions(frames: DataFrame, keys: Sequence[str] = KEYS, top: int = 20) -> DataFrame:
    """First exception responses per capture."""
    found = frames.where(F.col("fc").bitwiseAND(F.lit(EXCEPTION)) != 0)
    return _first(found, keys, top).select(*keys, "rank", "ts", "device", "fc", u8("raw", 2).alias("code"))


def anomaly_counts(frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    write = (F.col("fc") == WRITE_SINGLE) & (F.col("role") == REQUEST)
    return frames.groupBy(*keys).agg(
        F.count_if(write).alias("writes"),
        F.count_if(F.col("fc").bitwiseAND(F.lit(EXCEPTION)) != 0).alias("exceptions"),
    )


def poll_coverage(pairs: DataFrame, every: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct devices, blocks and device x block combinations read per period."""
    reads = pairs.where(F.col("fc").isin(READ_HOLDING, READ_INPUT))
    seen = reads.select(*keys, F.window("req_ts", every)["start"].alias("period"), *QUERY).distinct()
    blocks = seen.groupBy(*keys, "period", "fc", "addr", "count").agg(F.count("*").alias("devices"))
    return blocks.groupBy(*keys, "period").agg(
        F.count("*").alias("blocks"), F.max("devices").alias("devices"), F.sum("devices").alias("combinations")
    )


def comms_failures(
    frames: DataFrame | Run, answered: Column, keys: Sequence[str] = KEYS, at_least: int = 20,
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Runs of consecutive requests without an answer."""
    return islands(frames, keys, ["off"], ~answered, "ts", at_least, rows_per_cut)


def unanswered(
    frames: DataFrame | Run, keys: Sequence[str] = KEYS, at_least: int = 20, rows_per_cut: int | None = None
) -> DataFrame:
    """Per device: polls missed in a row. A poll is answered when the next frame is its
    response."""
    slim = run(frames, keys, ["off"], rows_per_cut).select(*keys, "off", "ts", "role", "device", "fc")
    nxt = F.struct("role", "device", "fc")
    asked = slim.lead({"__rsp": nxt}).where(F.col("role") == REQUEST)
    answered = F.coalesce(
        (F.col("__rsp.role") != REQUEST) & (F.col("__rsp.device") == F.col("device")), F.lit(False)
    )
    flagged = asked.select(*keys, "off", "ts", "role", "device", "fc", answered.alias("answered"))
    return comms_failures(flagged, F.col("answered"), [*keys, "device"], at_least, rows_per_cut)


def report(walked: DataFrame | Run, pairs: DataFrame | Run, keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """All sections of the capture report. Several read the pairs, so a run of them is stored."""
    if isinstance(pairs, Run):
        pairs = pairs.store()
    rows, found = rows_of(walked), rows_of(pairs)
    frames = frames_only(rows)
    return {
        "totals": capture_totals(rows, found, keys),
        "frame_summary": frame_summary(frames, keys),
        "cadence": cadence(pairs, keys),
        "latency": top_queries(latency(found, keys), keys),
        "writes": writes(frames, keys),
        "exceptions": exceptions(frames, keys),
    }
