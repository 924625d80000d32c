"""Scalar expressions: bits, split words, names, time and nested lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType


def bit(value: Column, index: Column | int) -> Column:
    """Bit of an integer column, as INT."""
    return F.getbit(value, F.lit(index)).cast("int")


def stacked_bit(value: Column, index: int, lane: int) -> Column:
    """Bit shifted to its own lane (0/1, 2/3, ...) so flags plot above each other."""
    return bit(value, index) + 2 * lane


def split_word(first: Column, second: Column | None, byte_offset: int) -> Column:
    """Word that starts ``byte_offset`` bytes into a register. Even offsets are the
    register itself; odd ones straddle two. NULL when a needed register is unknown."""
    if byte_offset % 2 == 0:
        return first.cast("int")
    low_of_first = first.bitwiseAND(F.lit(255))
    return (F.shiftleft(low_of_first, 8) + F.shiftright(second, 8)).cast("int")


def register_column(device: int, fc: int, reg: int, offset: int = 0) -> str:
    name = f"device_{device:03d}_fc_{fc:02d}_reg_{reg:05d}"
    return f"{name}_byte_{offset:03d}" if offset else name


def register_label(device: Column, fc: Column, reg: Column) -> Column:
    """Same name as :func:`register_column`, as an expression over rows."""
    return F.format_string("device_%03d_fc_%02d_reg_%05d", device, fc, reg)


def duration_ms(start: Column, end: Column) -> Column:
    """Elapsed milliseconds between two naive timestamps, as DOUBLE, whatever the session zone."""
    return (ntz_micros(end) - ntz_micros(start)) / F.lit(1000.0)


def micros(ts: Column, kind: DataType) -> Column:
    """Microseconds since 1970 of a column of type ``kind``; naive times don't depend on the zone."""
    return ntz_micros(ts) if isinstance(kind, TimestampNTZType) else F.unix_micros(ts.cast("timestamp"))


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session zone."""
    since = ts - F.lit("1970-01-01").cast("timestamp_ntz")

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), since)

    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def local_to_utc(ts: Column, zone: str | Column) -> Column:
    """Naive wall-clock TIMESTAMP_NTZ of a zone to an instant."""
    zone_col = F.lit(zone) if isinstance(zone, str) else zone
    return F.convert_timezone(zone_col, F.current_timezone(), ts).cast("timestamp")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def first_present(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


def first_in_roots(field: str, root: str | None, members: str | None, plant: str | None) -> Column:
    """First non-null ``field`` over a record, then each element of an array of
    records in order, then an outer record."""
    parts = []
    if root:
        parts.append(F.col(root)[field])
    if members:
        held = F.filter(F.col(members), lambda m: m[field].isNotNull())
        parts.append(F.get(held, F.lit(0))[field])
    if plant:
        parts.append(F.col(plant)[field])
    return F.coalesce(*parts)


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every column name except ``keep``."""
    names = {c: f"{prefix}{c}" for c in df.columns if c not in keep}
    return df.withColumnsRenamed(names)


def column_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    """Column if present, typed NULL otherwise."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)
