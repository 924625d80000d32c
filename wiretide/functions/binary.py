"""Column expressions over BINARY payloads: word access, text, hex and CRC."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

CRC_POLY = 0xA001
CRC_INIT = 0xFFFF


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        reg = byte
        for _ in range(8):
            reg = (reg >> 1) ^ (CRC_POLY if reg & 1 else 0)
        table.append(reg)
    return table


CRC_TABLE = _crc_table()
_CRC_NP = np.array(CRC_TABLE, dtype=np.uint16)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def u8(data: Column | str, offset: Column | int) -> Column:
    """Unsigned byte at a 0-based offset; NULL past the end."""
    piece = F.substring(_col(data), F.lit(offset) + 1, F.lit(1))
    return F.when(F.length(piece) == 1, F.conv(F.hex(piece), 16, 10).cast("int"))


def u16(data: Column | str, offset: Column | int) -> Column:
    """Unsigned big-endian word at a 0-based offset; NULL past the end."""
    piece = F.substring(_col(data), F.lit(offset) + 1, F.lit(2))
    return F.when(F.length(piece) == 2, F.conv(F.hex(piece), 16, 10).cast("int"))


def u32(data: Column | str, offset: Column | int) -> Column:
    """Unsigned big-endian double word as BIGINT; NULL past the end."""
    piece = F.substring(_col(data), F.lit(offset) + 1, F.lit(4))
    return F.when(F.length(piece) == 4, F.conv(F.hex(piece), 16, 10).cast("bigint"))


def to_signed16(word: Column) -> Column:
    """Two's complement view of an unsigned 16-bit value."""
    return F.when(word >= 0x8000, word - 0x10000).otherwise(word).cast("int")


def s16(data: Column | str, offset: Column | int) -> Column:
    return to_signed16(u16(data, offset))


def s32(data: Column | str, offset: Column | int) -> Column:
    wide = u32(data, offset)
    return F.when(wide >= 2**31, wide - 2**32).otherwise(wide)


def ascii_text(data: Column | str, offset: int, width: int) -> Column:
    """Fixed-width text, one character per byte, not trimmed; bytes outside
    7-bit ASCII become the replacement character."""
    latin = F.decode(F.substring(_col(data), offset + 1, width), "ISO-8859-1")
    return F.regexp_replace(latin, "[^\\x00-\\x7F]", "�")


def word_bytes(word: Column) -> Column:
    """Two big-endian bytes of an integer in 0..65535."""
    return F.unhex(F.lpad(F.hex(word.cast("bigint")), 4, "0"))


def byte_bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2, "0"))


def hex_word(word: Column) -> Column:
    return F.format_string("0x%04X", word)


def crc16_native(data: Column | str) -> Column:
    """CRC-16 with the reflected polynomial, built-in expressions only."""
    data = _col(data)
    table = F.lit(CRC_TABLE)

    def step(acc: Column, pos: Column) -> Column:
        index = acc.bitwiseXOR(u8(data, pos - 1)).bitwiseAND(F.lit(255))
        return F.shiftright(acc, 8).bitwiseXOR(F.element_at(table, index + 1))

    walked = F.aggregate(F.sequence(F.lit(1), F.length(data)), F.lit(CRC_INIT), step)
    return F.when(F.length(data) == 0, F.lit(CRC_INIT)).otherwise(walked)


def _pair_table() -> np.ndarray:
    """Register after two zero bytes, for every register: two bytes per look-up."""
    reg = np.arange(65536, dtype=np.uint16)
    for _ in range(2):
        reg = (reg >> 8) ^ _CRC_NP[reg & 0xFF]
    return reg


_PAIRS_NP = _pair_table()
_PAIRS = _PAIRS_NP.tolist()


def crc16_bytes(data: bytes) -> int:
    """CRC of one byte string."""
    reg = CRC_INIT
    for pair in struct.unpack_from(f"<{len(data) // 2}H", data):
        reg = _PAIRS[reg ^ pair]
    if len(data) % 2:
        reg = (reg >> 8) ^ CRC_TABLE[(reg ^ data[-1]) & 0xFF]
    return reg


def crc16_many(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC of many slices of one byte buffer: slices of equal length go together."""
    out = np.full(len(starts), CRC_INIT, dtype=np.uint16)
    for size in np.unique(lengths):
        if size == 0:
            continue
        rows = np.flatnonzero(lengths == size)
        block = np.lib.stride_tricks.sliding_window_view(buffer, size)[starts[rows]]
        reg = out[rows]
        for pair in np.ascontiguousarray(block[:, : size // 2 * 2]).view("<u2").T.copy():
            reg = _PAIRS_NP[reg ^ pair]
        if size % 2:
            reg = (reg >> 8) ^ _CRC_NP[(reg ^ block[:, -1]) & 0xFF]
        out[rows] = reg
    return out


def payload(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a BINARY or text column in one buffer, where each row begins, and its length (NULL: 0)."""
    data = data.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int64) if len(data) else np.zeros(1, np.int64)
    offsets = offsets[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    size = np.where(data.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)) if data.null_count else np.diff(offsets)
    return np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets[:-1], size


def pieces(buffer: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """``size`` bytes from each start, as a matrix; zeros behind the end of the buffer."""
    return np.lib.stride_tricks.sliding_window_view(np.r_[buffer, np.zeros(size, np.uint8)], size)[starts]


@F.arrow_udf(ArrayType(IntegerType()))
def words(data: pa.Array) -> pa.Array:
    """All unsigned big-endian words of a BINARY column, vectorised over each Arrow batch; an odd last byte
    is left out."""
    raw, at, size = payload(data)
    ends = np.r_[0, np.cumsum(size // 2)]
    place = np.repeat(at - 2 * ends[:-1], size // 2) + 2 * np.arange(ends[-1])
    values = raw[place].astype(np.int32) << 8 | raw[place + 1]
    missing = data.is_null() if data.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values), mask=missing)


@F.arrow_udf(IntegerType())
def crc16(data: pa.Array) -> pa.Array:
    """CRC-16 of a BINARY column, vectorised over each Arrow batch."""
    codes = crc16_many(*payload(data))
    mask = data.is_null().to_numpy(zero_copy_only=False)
    return pa.array(codes.astype(np.int32), mask=mask)


def crc_bytes(crc: Column) -> Column:
    """Wire form of a CRC: low byte first."""
    return F.concat(byte_bytes(crc.bitwiseAND(F.lit(255))), byte_bytes(F.shiftright(crc, 8)))


def with_crc(body: Column) -> Column:
    """Append the CRC to a frame body."""
    return F.concat(body, crc_bytes(crc16(body)))


def wire_crc(frame: Column | str) -> Column:
    """CRC stored in the last two bytes of a frame."""
    frame = _col(frame)
    size = F.length(frame)
    return u8(frame, size - 2) + u8(frame, size - 1) * 256


def valid_crc(frame: Column | str, crc=crc16) -> Column:
    """TRUE when the frame has at least 4 bytes and its stored CRC agrees."""
    frame = _col(frame)
    body = frame.substr(F.lit(1), F.length(frame) - 2)
    return (F.length(frame) >= 4) & (crc(body) == wire_crc(frame))
