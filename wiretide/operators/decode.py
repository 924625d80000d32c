"""Paired frames to named fields and to single registers; and back to frames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.functions.binary import (
    ascii_text,
    byte_bytes,
    crc_bytes,
    crc16,
    s16,
    s32,
    to_signed16,
    u8,
    u16,
    u32,
    word_bytes,
    words,
)
from wiretide.operators.framing import EXCEPTION, READ_HOLDING, READ_INPUT, WRITE_SINGLE
from wiretide.operators.layouts import BLOCKS, STANDARD, Block, Field
from wiretide.operators.runs import Run

_READERS = {"u8": u8, "u16": u16, "s16": s16, "u32": u32, "s32": s32}
_DATA_START = {READ_HOLDING: 3, READ_INPUT: 4}
#: So many fields are read one by one.
FEW_FIELDS = 4


def read_field(data: Column | str, field: Field, header: int = 0) -> Column:
    """A field out of a block's data, which starts ``header`` bytes into ``data``."""
    if field.kind == "text20":
        return ascii_text(data, header + field.offset, 20)
    value = _READERS[field.kind](data, header + field.offset)
    return value + field.bias if field.bias else value


def _field_of_words(held: Column, field: Field) -> Column:
    """:func:`read_field` out of the words of a block's data."""

    def pair(offset: int) -> Column:
        word = F.get(held, F.lit(offset // 2))
        if offset % 2 == 0:
            return word
        return F.shiftleft(word.bitwiseAND(F.lit(255)), 8) + F.shiftright(F.get(held, F.lit(offset // 2 + 1)), 8)

    if field.kind == "u8":
        word = F.get(held, F.lit(field.offset // 2))
        value = word.bitwiseAND(F.lit(255)) if field.offset % 2 else F.shiftright(word, 8)
    elif field.kind in ("u16", "s16"):
        value = pair(field.offset)
        value = to_signed16(value) if field.kind == "s16" else value
    else:
        value = pair(field.offset).cast("bigint") * 65536 + pair(field.offset + 2)
        value = F.when(value >= 2**31, value - 2**32).otherwise(value) if field.kind == "s32" else value
    return value + field.bias if field.bias else value


def decode_data(df: DataFrame, data: str, block: str, fields: Iterable[Field] = STANDARD) -> DataFrame:
    """Decode one block from its bare data; other lengths give NULL fields."""
    fits = F.length(data) == BLOCKS[block].size
    return df.withColumns(
        {f.name: F.when(fits, read_field(data, f)) for f in fields if f.block == block}
    )


def _is_block(block: Block, strict_start: bool) -> Column:
    framed = _DATA_START[block.fc] + block.size + 2
    test = (F.col("rsp_fc") == block.fc) & (F.length("rsp_raw") == framed)
    if block.fc == READ_INPUT or strict_start:
        test = test & (F.col("addr") == block.start)
    return test


def decode_pairs(
    pairs: DataFrame, fields: Sequence[Field] = STANDARD, strict_start: bool = False
) -> DataFrame:
    """One sparse wide row per pair; which columns are filled depends on the block. Of more than a few fields
    the words are read together, in batches."""
    values, many = {}, len(fields) > FEW_FIELDS
    for f in fields:
        block = BLOCKS[f.block]
        alone = not many or f.kind == "text20"
        value = read_field("rsp_raw", f, _DATA_START[block.fc]) if alone else _field_of_words(F.col("__words"), f)
        values[f.name] = F.when(_is_block(block, strict_start), value)
    if not many:
        return pairs.withColumns(values)
    start = F.when(F.col("rsp_fc") == READ_HOLDING, _DATA_START[READ_HOLDING]).otherwise(_DATA_START[READ_INPUT])
    data = F.substring(F.col("rsp_raw"), start + 1, F.length("rsp_raw"))
    return pairs.withColumn("__words", words(data)).withColumns(values).drop("__words")


def wire_table(
    pairs: DataFrame | Run,
    keys: Sequence[str] = ("capture_id",),
    fields: Sequence[Field] = STANDARD,
    strict_start: bool = False,
) -> DataFrame | Run:
    """Decoded rows stamped with the response time. Pairs that are laid out stay so."""
    decoded = decode_pairs(pairs.df if isinstance(pairs, Run) else pairs, fields, strict_start)
    decoded = replace(pairs, df=decoded) if isinstance(pairs, Run) else decoded
    return decoded.select(
        *keys,
        "pair_off",
        F.col("rsp_ts").alias("ts"),
        "device",
        F.col("rsp_fc").alias("fc"),
        "addr",
        "count",
        *[f.name for f in fields],
    )


def carries_registers() -> tuple[Column, Column]:
    """Whether a pair's response carries all requested registers, and where they start."""
    raw, count = F.col("rsp_raw"), F.col("count")
    plain = F.col("rsp_fc") != F.col("fc").bitwiseOR(F.lit(EXCEPTION))
    holding = (
        (F.col("fc") == READ_HOLDING)
        & (u8(raw, 2) == 2 * count)
        & (F.length(raw) >= 2 * count + 5)
    )
    inputs = (
        (F.col("fc") == READ_INPUT)
        & (F.length(raw) >= F.greatest(2 * count + 6, F.lit(6)))
        & (u16(raw, 2) == F.col("addr"))
    )
    whole = plain & (F.length("req_raw") >= 8) & (holding | inputs)
    return whole, F.when(F.col("fc") == READ_HOLDING, 3).otherwise(4)


def _writes_register() -> Column:
    plain = F.col("rsp_fc") != F.col("fc").bitwiseOR(F.lit(EXCEPTION))
    return plain & (F.col("fc") == WRITE_SINGLE) & (F.length("req_raw") >= 8)


def _updates() -> Column:
    """The words of the registers a pair updates, from its start address on: a read's words come from the
    response, a write's from the request."""
    whole, start = carries_registers()
    sent = F.when(whole & (F.col("count") > 0), F.substring(F.col("rsp_raw"), start + 1, 2 * F.col("count")))
    return F.when(sent.isNotNull(), words(sent)).when(_writes_register(), F.array(u16("req_raw", 4)))


def _update_columns(keys: Sequence[str]) -> list[Column | str]:
    kept = [*keys, "pair_off", F.col("rsp_ts").alias("ts"), "device", "fc"]
    return [*kept, "addr", F.posexplode(_updates()).alias("__nth", "value")]


def register_rows(pairs: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """One row per register a pair updates. Reads take the response's words; a write
    takes the request's."""
    spread = pairs.select(*_update_columns(keys))
    return spread.select(*keys, "pair_off", "ts", "device", "fc", (F.col("addr") + F.col("__nth")).alias("reg"), "value")


def register_updates(pairs: Run, keys: Sequence[str] = ("capture_id",), blocks: bool = False) -> Run:
    """:func:`register_rows` in the layout of the pairs. ``blocks`` leaves the registers of a pair in one row,
    as ``addr`` and the ``values`` of the registers from there on."""
    if blocks:
        kept = [*keys, "pair_off", F.col("rsp_ts").alias("ts"), "device", "fc", "addr"]
        return pairs.select(*kept, _updates().alias("values")).where(F.col("values").isNotNull())
    spread = pairs.select(*_update_columns(keys))
    return spread.select(*keys, "pair_off", "ts", "device", "fc", (F.col("addr") + F.col("__nth")).alias("reg"), "value")


def key_registers(pairs: DataFrame) -> DataFrame:
    """``(device, fc, reg)`` of all registers that any pair updates: requests are made distinct
    before their ranges are spread, so pairs themselves are not."""
    whole, _ = carries_registers()
    size = F.when(whole & (F.col("count") > 0), F.col("count")).when(_writes_register(), 1)
    asked = pairs.select("device", "fc", "addr", size.alias("__n")).where(F.col("__n").isNotNull()).distinct()
    return asked.select("device", "fc", F.explode(F.sequence(F.col("addr"), F.col("addr") + F.col("__n") - 1)).alias("reg")).distinct()


def register_value(device: int, fc: int, reg: int) -> Column:
    """Value a pair gives one register, or NULL; the same rules without an explode."""
    whole, start = carries_registers()
    mine = (F.col("device") == device) & (F.col("fc") == fc)
    at = F.lit(reg) - F.col("addr")
    read = mine & at.between(0, F.col("count") - 1) & whole
    write = mine & (at == 0) & _writes_register()
    if fc == WRITE_SINGLE:
        return F.when(write, u16("req_raw", 4))
    return F.when(read, u16("rsp_raw", start + 2 * at))


# -- encoding ---------------------------------------------------------------------


def words_binary(words: Column) -> Column:
    """ARRAY<INT> of 16-bit values to big-endian bytes."""
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w.cast("bigint")), 4, "0")), ""))


def request_body(device: Column, fc: Column, start: Column, count: Column) -> Column:
    return F.concat(byte_bytes(device), byte_bytes(fc), word_bytes(start), word_bytes(count))


def response_body(device: Column, fc: Column, start: Column, data: Column) -> Column:
    """Response without CRC: a byte count for holding reads, the start for input reads."""
    head = F.when(fc == READ_HOLDING, byte_bytes(F.length(data))).otherwise(word_bytes(start))
    return F.concat(byte_bytes(device), byte_bytes(fc), head, data)


def sealed(df: DataFrame, column: str) -> DataFrame:
    """Append the CRC to a frame body column."""
    return df.withColumn(column, F.concat(F.col(column), crc_bytes(crc16(column))))
