"""Removal of private identifiers: serials and addresses in text, serials in bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from wiretide.functions.binary import crc16, crc_bytes, valid_crc

IP_MASK = "X.X.X.X"


def _ordered(items: Sequence[str]) -> list[str]:
    """Distinct, non-empty, longest first, so no item hides inside a longer one."""
    return sorted({i for i in items if i}, key=lambda i: (-len(i), i))


def _quoted(item: str) -> str:
    return "\\Q" + item.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def redact_text(text: Column, serials: Sequence[str] = (), ips: Sequence[str] = ()) -> Column:
    """Mask serials as text and as spaced hex (either case), and addresses. An address
    is masked only where no further digit or dotted group continues it."""
    out = text
    for serial in _ordered(serials):
        out = F.replace(out, F.lit(serial), F.lit("X" * len(serial)))
        mask = " ".join(["XX"] * len(serial))
        for form in ("%02x", "%02X"):
            spelled = " ".join(form % ord(ch) for ch in serial)
            out = F.replace(out, F.lit(spelled), F.lit(mask))
    for ip in _ordered(ips):
        edge = r"(?<![0-9])(?<![0-9]\.)" + _quoted(ip) + r"(?![0-9])(?!\.[0-9])"
        out = F.regexp_replace(out, edge, IP_MASK)
    return out


def redact_hex(data: Column, serials: Sequence[str]) -> Column:
    """Mask serial bytes inside a payload; length is kept. Hex is spaced per byte so a
    match can only start on a byte."""
    spaced = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    for serial in _ordered(serials):
        spelled = "".join(f"{b:02X} " for b in serial.encode("ascii"))
        spaced = F.replace(spaced, F.lit(spelled), F.lit("58 " * len(serial)))
    return F.unhex(F.replace(spaced, F.lit(" "), F.lit("")))


def redact_frames(frames: DataFrame, serials: Sequence[str], raw: str = "raw") -> DataFrame:
    """Mask serials inside frames. Frames that were valid stay valid: their CRC is redone."""
    body = F.col(raw).substr(F.lit(1), F.length(raw) - 2)
    hidden = redact_hex(body, serials)
    checked = frames.withColumn("__ok", valid_crc(raw)).withColumn("__body", hidden)
    resealed = F.concat("__body", crc_bytes(crc16("__body")))
    touched = F.col("__body") != F.substring(raw, 1, F.length("__body"))
    masked = F.when(F.col("__ok") & touched, resealed).when(~F.col("__ok"), redact_hex(F.col(raw), serials))
    return checked.withColumn(raw, F.coalesce(masked, F.col(raw))).drop("__ok", "__body")


def redact_table(
    df: DataFrame, serials: Sequence[str] = (), ips: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """Every text column as text, every binary column as bytes; others stay."""
    out = {}
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, StringType):
            out[field.name] = redact_text(F.col(field.name), serials, ips)
        elif isinstance(field.dataType, BinaryType):
            out[field.name] = redact_hex(F.col(field.name), serials)
    return df.withColumns(out) if out else df


TEXT_SUFFIXES = (".log", ".ndjson", ".json", ".md", ".csv", ".txt")  # fixed values


def is_text_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*TEXT_SUFFIXES)
