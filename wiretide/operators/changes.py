"""Changes between consecutive readings: values, bits, differences, gaps, outages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.functions.scalar import bit, micros
from wiretide.operators.runs import Run, run


def changes(
    df: DataFrame | Run, keys: Sequence[str], order: Sequence[str], field: str, rows_per_cut: int | None = None
) -> DataFrame:
    """Rows where ``field`` differs from the reading before, with ``prev_value`` and
    ``new_value``. Rows without the field are not readings; the first one is no change."""
    present = df.where(F.col(field).isNotNull())
    seen = run(present, keys, order, rows_per_cut).lag({"prev_value": F.col(field)}).done()
    return seen.where(F.col("prev_value") != F.col(field)).withColumn("new_value", F.col(field))


def auto_tags(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], field: str, ts: str = "ts",
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Changes as tag events, stamped with the time of the changed record."""
    text = F.format_string(f"auto:{field}:%s->%s", F.col("prev_value").cast("string"), F.col("new_value").cast("string"))
    found = changes(df, keys, order, field, rows_per_cut)
    return found.select(*keys, ts, text.alias("tag"), F.lit("auto").alias("source"))


def difference(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "delta",
    rows_per_cut: int | None = None,
) -> DataFrame:
    """``value`` minus the one before, over non-null readings; NULL on the first."""
    present = df.where(F.col(value).isNotNull())
    seen = run(present, keys, order, rows_per_cut).lag({"__before": F.col(value)}).done()
    return seen.withColumn(out, F.col(value) - F.col("__before")).drop("__before")


def gap_us(
    df: DataFrame | Run, keys: Sequence[str], order: Sequence[str], ts: str, out: str = "gap_us",
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Microseconds since the row before, as BIGINT so that sums are exact."""
    seen = run(df, keys, order, rows_per_cut).lag({"__before": F.col(ts)}).done()
    kind = seen.schema[ts].dataType
    return seen.withColumn(out, micros(F.col(ts), kind) - micros(F.col("__before"), kind)).drop("__before")


def gap_summary(gaps: DataFrame, keys: Sequence[str], gap: str = "gap_us") -> DataFrame:
    """Rows per key and mean, least and greatest gap in milliseconds."""
    out = {"avg_ms": F.avg(gap), "min_ms": F.min(gap), "max_ms": F.max(gap)}
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("requests"), *[(c / F.lit(1000.0)).alias(n) for n, c in out.items()]
    )


def bit_transitions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, bits: int = 8,
    rows_per_cut: int | None = None,
) -> DataFrame:
    """One row per reading and bit that flipped: ``bit``, ``state`` after the flip. The
    word is compared once; only changed rows are spread over bits."""
    present = df.where(F.col(value).isNotNull())
    word = F.col(value).cast("bigint")
    seen = run(present, keys, order, rows_per_cut).lag({"__before": word}).done()
    mask = (1 << bits) - 1
    flipped = word.bitwiseXOR(F.col("__before")).bitwiseAND(F.lit(mask))
    spread = seen.withColumn("__flip", flipped).where(F.col("__flip") != 0)
    rows = spread.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    rows = rows.where(bit(F.col("__flip"), F.col("bit")) == 1)
    return rows.withColumn("state", bit(word, F.col("bit"))).drop("__flip", "__before")


def islands(
    df: DataFrame | Run, keys: Sequence[str], order: Sequence[str], bad: Column, ts: str = "ts",
    at_least: int = 1, rows_per_cut: int | None = None,
) -> DataFrame:
    """Runs of consecutive rows where ``bad`` holds: start, end and length. A good row
    ends a run, so the number of good rows so far identifies it."""
    flagged = run(df, keys, order, rows_per_cut).with_columns({"__bad": bad})
    good = F.when(F.col("__bad"), 0).otherwise(1).cast("bigint")
    placed = flagged.running_sum({"__run": good}).done()
    found = placed.where("__bad").groupBy(*keys, "__run").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("missed")
    )
    return found.where(F.col("missed") >= at_least).drop("__run")


def coincidences(
    flips: DataFrame, reported: DataFrame, keys: Sequence[str], tolerance_seconds: float,
    bits: int = 8, ts: str = "ts", rows_per_cut: int | None = None,
) -> DataFrame:
    """How many bit flips lie within the tolerance of a reported change, counted per
    ``(bit, prev_value, new_value)``.

    Nothing is paired up: flips are counted cumulatively along time, and every change
    reads those counters at both ends of its window.
    """
    reach = round(tolerance_seconds * 1_000_000)
    us = micros(F.col(ts), flips.schema[ts].dataType)
    none = F.lit(None).cast(reported.schema["prev_value"].dataType)
    events = flips.select(
        *keys, us.alias("__us"), F.lit(1).alias("__kind"), "bit",
        none.alias("prev_value"), none.alias("new_value"),
    )
    ends = [(us - reach, 0), (us + reach, 2)]  # before, and after, flips of equal time
    for at, kind in ends:
        events = events.unionByName(
            reported.select(
                *keys, at.alias("__us"), F.lit(kind).alias("__kind"), F.lit(None).cast("int").alias("bit"),
                "prev_value", "new_value",
            )
        )
    counters = {f"__b{b}": F.when(F.col("bit") == b, 1).otherwise(0) for b in range(bits)}
    counted = run(events, keys, ["__us", "__kind"], rows_per_cut).running_sum(counters).done()
    sign = F.col("__kind") - 1
    reads = F.array(*[F.struct(F.lit(b).alias("bit"), (sign * F.col(f"__b{b}")).alias("n")) for b in range(bits)])
    windows = counted.where(F.col("__kind") != 1).select(
        "prev_value", "new_value", F.explode(reads).alias("r")
    )
    totals = windows.groupBy("r.bit", "prev_value", "new_value").agg(F.sum("r.n").alias("n"))
    return totals.where(F.col("n") > 0)
