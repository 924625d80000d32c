"""Derived telemetry: absent packs, plausibility, holds, resampling, pack aggregates, units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.functions.scalar import bit, micros
from wiretide.operators.layouts import HR, IR1, IR2, IR3
from wiretide.operators.runs import run

# Plausibility limits, exclusive on both ends.
CELL_MV = (2200, 3700)
TEMP_DECIDEGC = (-300, 700)
CURRENT_LIMIT = 60000


def absent_block(data: Column, block: str) -> Column:
    """Whether a block's data is what an empty slot sends."""
    def zeros(count: int) -> str:
        return "00" * count

    empty = {
        IR1.name: (1, 32, zeros(20) + zeros(2) + "F556" * 5),
        IR2.name: (1, IR2.size, zeros(IR2.size)),
        IR3.name: (1, 32, zeros(32)),
    }
    if block == HR.name:
        return F.lit(False)
    start, length, pattern = empty[block]
    return F.hex(F.substring(data, start, length)) == pattern


def within(value: Column, limits: tuple[float, float]) -> Column:
    return (value > limits[0]) & (value < limits[1])


def hold_good(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, valid: Column, out: str = "held",
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Last valid reading; implausible ones are ignored."""
    return run(df, keys, order, rows_per_cut).last_known({out: F.when(valid, F.col(value))}).done()


def hold_with_age(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ts: str, stale_seconds: float,
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Last known reading with its age and a stale flag: ``held``, ``age_seconds``, ``stale``."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(ts).alias("t")))
    held = run(df, keys, order, rows_per_cut).last_known({"__held": seen}).done()
    kind = df.schema[ts].dataType
    age = (micros(F.col(ts), kind) - micros(F.col("__held.t"), kind)) / F.lit(1_000_000.0)
    out = {"held": F.col("__held.v"), "age_seconds": age}
    return held.withColumns(out).withColumn("stale", F.col("age_seconds") > stale_seconds).drop("__held")


def resample(
    df: DataFrame, keys: Sequence[str], ts: str, every: str, aggregates: Mapping[str, Column]
) -> DataFrame:
    """Tumbling-window aggregates, e.g. ``every='1 second'``; also on a watermarked stream."""
    grouped = df.groupBy(*keys, F.window(ts, every).alias("__w"))
    rows = grouped.agg(*[c.alias(n) for n, c in aggregates.items()])
    return rows.select(*keys, F.col("__w.start").alias(ts), *aggregates)


def pack_readings(
    wire: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Every decoded row with the last known fields of its own device."""
    by = [*keys, "device"]
    return run(wire, by, order, rows_per_cut).last_known({f: F.col(f) for f in fields}).done()


def multi_pack(
    readings: DataFrame, keys: Sequence[str], ts: str, every: str, *, order: Column, device: str = "device",
    total: Sequence[str] = (), one: Sequence[str] = (), lowest: Sequence[str] = (), highest: Sequence[str] = (),
) -> DataFrame:
    """Parallel packs as one: per period and device the latest reading, then sums of
    currents and capacities, one pack's voltage, lowest and highest of the rest."""
    fields = [*total, *one, *lowest, *highest]
    period = F.window(ts, every).alias("__w")
    latest = readings.groupBy(*keys, device, period).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    )
    rows = latest.groupBy(*keys, "__w").agg(
        F.count("*").alias("packs"),
        *[F.sum(f).alias(f) for f in total],
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(device))).alias(f) for f in one],
        *[F.min(f).alias(f) for f in lowest],
        *[F.max(f).alias(f) for f in highest],
    )
    return rows.select(*keys, F.col("__w.start").alias(ts), "packs", *fields)


def state_of_charge(remaining: Column, calibrated: Column) -> Column:
    return remaining / F.nullif(calibrated, F.lit(0)) * 100


def other_protocol_units(df: DataFrame, cells: Column, temps: Column | None = None) -> DataFrame:
    """Fields in the units of a common pack-broadcast protocol. ``cells`` is an array of
    mV per cell; ids of the extreme cells are 1-based, lowest cell first on ties. The current is
    that of the wide pack block, else of the holding registers, in tenths of an ampere; fields
    whose source column is not decoded are NULL."""
    def scaled(name: str, by: int) -> Column:
        return F.col(name) / by if name in df.columns else F.lit(None).cast("double")

    out = {
        "BatteryVoltage": scaled("pack_voltage_mV", 10),
        "BatteryCurrent": scaled("pack_current_mA", 100) if "pack_current_mA" in df.columns else scaled("hr23_pack_current_cA", 10),
        "RatedCapacity": scaled("total_cap_cAh", 10),
        "MinCellVoltage": F.array_min(cells),
        "MaxCellVoltage": F.array_max(cells),
        "MinCellId": F.array_position(cells, F.array_min(cells)).cast("int"),
        "MaxCellId": F.array_position(cells, F.array_max(cells)).cast("int"),
        "MaxChargeCurrent": scaled("hr26_charge_limit_cA", 10),
        "MaxDischargeCurrent": scaled("hr27_discharge_limit_cA", 10),
    }
    if "soc_pct" in df.columns:
        out["SoC"] = F.col("soc_pct")
    if temps is not None:
        out["MinCellTemperature"] = F.array_min(temps)
        out["MaxCellTemperature"] = F.array_max(temps)
    return df.withColumns(out)


def direction(status: Column) -> Column:
    """Current direction from the two lowest status bits."""
    code = bit(status, 1) * 2 + bit(status, 0)
    return F.when(code == 1, "idle").when(code == 2, "charge").when(code == 3, "discharge")


def status_names(status: Column, names: Mapping[int, str]) -> Column:
    """Names of the raised bits of a status byte, lowest bit first; NULL status, NULL names."""
    raised = F.array(*[F.when(bit(status, b) == 1, F.lit(n)) for b, n in sorted(names.items())])
    return F.when(status.isNotNull(), F.array_compact(raised))
