"""A bus capture encoded from the ``lineitem`` table.

Each row becomes one exchange: a register read of one of the known blocks, a register
write, a read answered by an exception, or a read nobody answers. Register words are
arithmetic on the row's integers, so every decoded value can be checked with plain SQL.
Noise bytes precede some exchanges and some packs are absent.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.functions.binary import byte_bytes, word_bytes
from wiretide.operators import runs
from wiretide.operators.decode import request_body, sealed, words_binary
from wiretide.operators.runs import Run, run, spread
from wiretide.sources.hexdump import format_run

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ABSENT_TEMP = 0xF556

# -- the same derivation twice: as columns here, as SQL text below ----------------


def word(i: Column | int) -> Column:
    """Plain register word ``i`` of a row."""
    return F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.lit(i) * 257, F.lit(65536)).cast("int")


def block_word(i: Column) -> Column:
    """Word ``i`` as sent: digits for a serial, fixed patterns for an absent pack."""
    digits = (48 + F.pmod(F.col("l_suppkey") + i, F.lit(10))) * 256 + 48 + F.pmod(F.col("l_partkey") + i, F.lit(10))
    empty = F.when((F.col("kind") == "IR1") & i.between(11, 15), ABSENT_TEMP).when(
        (F.col("kind") == "IR3") & i.between(16, 17), ABSENT_TEMP
    ).otherwise(0)
    sent = F.when(F.col("absent"), empty).when((F.col("kind") == "IR1") & (i < 10), digits).otherwise(word(i))
    return sent.cast("int")


def _lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The columns that exchanges are made of, and their capture."""
    rows = spread(spark.read.parquet(f"{folder}/lineitem.parquet").select(*ORDER, "l_quantity"))
    bus = F.when(F.col("l_suppkey") % 3 == 0, "bus_0").otherwise(
        F.concat(F.lit("bus_"), (1 + F.col("l_suppkey") % 7).cast("string"))
    )
    return rows.withColumn("capture_id", bus)


def exchanges(rows: DataFrame) -> DataFrame:
    """One row per exchange: keys, kind, request fields, times and data words. Other columns stay."""
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    kind = (
        F.when(qty == 50, "write").when(qty == 49, "exception").when(qty == 48, "silent")
        .when(line == 5, "IR1").when(line == 6, "IR2").when(line == 7, "IR3").otherwise("HR")
    )
    millis = F.col("l_orderkey") * 1000 + line * 100
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")

    def at(ms: Column) -> Column:
        return start + ms * F.lit(timedelta(milliseconds=1))

    rows = rows.withColumn("kind", kind).withColumn(
        "absent", (qty == 47) & F.col("kind").isin("IR1", "IR2", "IR3")
    )
    sizes = {"IR1": 21, "IR2": 19, "IR3": 20}
    count, addr = F.lit(28), F.lit(0)
    for name, size in sizes.items():
        count = F.when(F.col("kind") == name, size).otherwise(count)
    for name, first in {"IR2": 21, "IR3": 40, "write": 231}.items():
        addr = F.when(F.col("kind") == name, first).otherwise(addr)
    made = {
        "device": F.element_at(F.lit([1, 2, 5]), (1 + line % 3).cast("int")),
        "fc": F.when(F.col("kind") == "write", 6).when(F.col("kind").startswith("IR"), 4).otherwise(3),
        "addr": addr,
        "count": F.when(F.col("kind") == "write", word(0)).otherwise(count),
        "noise": F.when(line == 7, 2).otherwise(0),
        "req_ts": at(millis),
        "rsp_ts": at(millis + 84 + F.col("l_partkey") % 31),
    }
    return rows.withColumns(made)


#: Words of the longest block that is read.
LONGEST_BLOCK = 28


def _plain_data(count: Column) -> Column:
    """Plain words as bytes, four to a BIGINT so that a block takes few conversions. The longest block
    is written out, since a lambda per four words costs more than they do; rows without a key have no words."""
    base = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7

    def quad(at: int) -> Column:
        first = base + F.lit(at * 1028)
        words = [(first + i * 257).bitwiseAND(F.lit(65535)) for i in range(4)]
        packed = F.shiftleft(words[0], 48) + F.shiftleft(words[1], 32) + F.shiftleft(words[2], 16) + words[3]
        return F.lpad(F.hex(packed), 16, "0")

    text = F.coalesce(F.concat(*[quad(at) for at in range(LONGEST_BLOCK // 4)]), F.lit(""))
    return F.unhex(F.substring(text, F.lit(1), 4 * count))


def with_bytes(rows: DataFrame) -> DataFrame:
    """Add ``req_raw`` and ``rsp_raw`` (NULL when unanswered), CRC included."""
    special = F.col("absent") | (F.col("kind") == "IR1")
    block = F.transform(F.sequence(F.lit(0), F.col("count") - 1), block_word)
    data = F.when(special, words_binary(block)).otherwise(_plain_data(F.col("count")))
    head = F.when(F.col("fc") == 3, byte_bytes(2 * F.col("count"))).otherwise(word_bytes(F.col("addr")))
    request = request_body(F.col("device"), F.col("fc"), F.col("addr"), F.col("count"))
    answer = (
        F.when(F.col("kind") == "write", request)
        .when(F.col("kind") == "exception", F.concat(byte_bytes(F.col("device")), byte_bytes(F.col("fc") + 128), F.unhex(F.lit("02"))))
        .when(F.col("kind") != "silent", F.concat(byte_bytes(F.col("device")), byte_bytes(F.col("fc")), head, data))
    )
    return sealed(sealed(rows.withColumns({"req_raw": request, "rsp_raw": answer}), "req_raw"), "rsp_raw")


#: Log lines of an exchange, about: a cut of exchanges holds as many lines as other cuts hold rows.
LINES_PER_EXCHANGE = 4


def flushes(spark: SparkSession, folder: str) -> Run:
    """Byte flushes ``(capture_id, *ORDER, flush, ts, bytes)``. The exchanges are laid out, encoded and
    stored once; flushes, lines and chunks made from them stay where they are."""
    sent = ["req_ts", "rsp_ts", "noise", "req_raw", "rsp_raw"]
    rows = run(_lineitem(spark, folder), ["capture_id"], ORDER, runs.ROWS_PER_CUT // LINES_PER_EXCHANGE).deal()
    laid = rows._with(with_bytes(exchanges(rows.df))).select("capture_id", *ORDER, *sent).store()
    noisy = F.concat(F.unhex(F.repeat(F.lit("00"), F.col("noise"))), F.col("req_raw"))
    both = F.array(
        F.struct(F.lit(0).alias("flush"), F.col("req_ts").alias("ts"), noisy.alias("bytes")),
        F.struct(F.lit(1).alias("flush"), F.col("rsp_ts").alias("ts"), F.col("rsp_raw").alias("bytes")),
    )
    spread = laid.select("capture_id", *ORDER, F.explode(both).alias("f"))
    return spread.select("capture_id", *ORDER, "f.*", order=[*ORDER, "flush"]).where(F.col("bytes").isNotNull())


LINE_KEYS = [*ORDER, "flush", "piece"]


def log_lines(spark: SparkSession, folder: str) -> Run:
    """The capture as hexdump text lines, laid out by capture."""
    return format_run(flushes(spark, folder), [*ORDER, "flush"])


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """The capture's frames without going through text: what framing must find."""
    rows = with_bytes(exchanges(_lineitem(spark, folder)))
    used = F.col("noise") + 8 + F.coalesce(F.length("rsp_raw"), F.lit(0))
    exchange = F.when(F.col("kind") != "write", F.col("kind"))
    placed = (
        run(rows, ["capture_id"], ORDER)
        .running_sum({"end": used.cast("bigint")})
        .last_known({"latest": exchange})
        .done()
    )
    # A write looks the same in both directions: with an answer still missing it counts
    # as that answer, and its echo as the next request.
    turned = F.coalesce((F.col("kind") == "write") & (F.col("latest") == "silent"), F.lit(False))
    roles = [F.when(turned, b).otherwise(a) for a, b in (("request", "response"), ("response", "request"))]
    request_off = F.col("end") - used + F.col("noise")
    code = F.when(F.col("kind") == "exception", F.col("fc") + 128).otherwise(F.col("fc"))
    both = F.array(
        F.struct(request_off.alias("off"), F.col("req_ts").alias("ts"), roles[0].alias("role"),
                 F.col("fc").alias("fc"), F.col("req_raw").alias("raw")),
        F.struct((request_off + 8).alias("off"), F.col("rsp_ts").alias("ts"), roles[1].alias("role"),
                 code.alias("fc"), F.col("rsp_raw").alias("raw")),
    )
    spread = placed.select("capture_id", "device", F.explode(both).alias("f")).select("capture_id", "device", "f.*")
    return spread.where(F.col("raw").isNotNull()).withColumn("len", F.length("raw"))


# -- SQL text of the derivation, for checks ----------------------------------------


def sql_word(i: int | str, prefix: str = "") -> str:
    p = prefix
    return f"(({p}l_orderkey*31 + {p}l_partkey*7 + ({i})*257) % 65536)"


def sql_sent(i: int | str) -> str:
    """SQL for word ``i`` as sent in a block."""
    digits = f"((48 + (l_suppkey + {i}) % 10)*256 + 48 + (l_partkey + {i}) % 10)"
    return (
        f"CAST(CASE WHEN absent THEN CASE WHEN kind='IR1' AND {i} BETWEEN 11 AND 15 THEN 62806 "
        f"WHEN kind='IR3' AND {i} BETWEEN 16 AND 17 THEN 62806 ELSE 0 END "
        f"WHEN kind='IR1' AND {i} < 10 THEN {digits} ELSE {sql_word(i)} END AS INTEGER)"
    )


SQL_EXCHANGES = f"""
k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  CASE WHEN l_quantity=50 THEN 'write' WHEN l_quantity=49 THEN 'exception' WHEN l_quantity=48 THEN 'silent'
       WHEN l_linenumber=5 THEN 'IR1' WHEN l_linenumber=6 THEN 'IR2' WHEN l_linenumber=7 THEN 'IR3' ELSE 'HR' END AS kind,
  CASE WHEN l_suppkey%3=0 THEN 'bus_0' ELSE 'bus_' || CAST(1+l_suppkey%7 AS VARCHAR) END AS capture_id
  FROM lineitem),
x AS (SELECT *, l_quantity=47 AND kind IN ('IR1','IR2','IR3') AS absent,
  CAST([1,2,5][CAST(1+l_linenumber%3 AS INTEGER)] AS INTEGER) AS device,
  CASE WHEN kind='write' THEN 6 WHEN kind IN ('IR1','IR2','IR3') THEN 4 ELSE 3 END AS fc,
  CASE kind WHEN 'IR2' THEN 21 WHEN 'IR3' THEN 40 WHEN 'write' THEN 231 ELSE 0 END AS addr,
  CASE kind WHEN 'IR1' THEN 21 WHEN 'IR2' THEN 19 WHEN 'IR3' THEN 20
       WHEN 'write' THEN CAST({sql_word(0)} AS INTEGER) ELSE 28 END AS "count",
  CASE WHEN l_linenumber=7 THEN 2 ELSE 0 END AS noise,
  CASE kind WHEN 'write' THEN 8 WHEN 'exception' THEN 5 WHEN 'silent' THEN 0 WHEN 'IR1' THEN 48 WHEN 'IR2' THEN 44
       WHEN 'IR3' THEN 46 ELSE 61 END AS rsp_len,
  TIMESTAMP '2026-01-01 00:00:00' + to_milliseconds(l_orderkey*1000 + l_linenumber*100) AS req_ts,
  TIMESTAMP '2026-01-01 00:00:00' + to_milliseconds(l_orderkey*1000 + l_linenumber*100 + 84 + l_partkey%31) AS rsp_ts
  FROM k),
b AS (SELECT *, row_number() OVER w AS rn,
  CAST(sum(noise+8+rsp_len) OVER w AS BIGINT) - 8 - rsp_len AS req_off,
  coalesce(last_value(CASE WHEN kind<>'write' THEN kind END IGNORE NULLS) OVER
    (PARTITION BY capture_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'silent', false) AS lost
  FROM x WINDOW w AS (PARTITION BY capture_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT capture_id, req_off AS off, req_ts AS ts, CASE WHEN lost AND kind='write' THEN 'response' ELSE 'request' END AS role,
        device, fc, 8 AS len, lost AND kind<>'write' AS swap, noise AS gap, addr, "count", kind FROM b
      UNION ALL
      SELECT capture_id, req_off+8, rsp_ts, CASE WHEN lost AND kind='write' THEN 'request' ELSE 'response' END, device,
        CASE WHEN kind='exception' THEN fc+128 ELSE fc END, rsp_len, false, 0, addr, "count", kind FROM b WHERE rsp_len>0),
p AS (SELECT capture_id, off AS req_off, device, fc, rsp_fc, ts AS req_ts, rsp_ts, addr, "count", kind FROM (
        SELECT *, lead(role) OVER n AS rsp_role, lead(device) OVER n AS rsp_device, lead(fc) OVER n AS rsp_fc, lead(ts) OVER n AS rsp_ts
        FROM f WINDOW n AS (PARTITION BY capture_id ORDER BY off))
      WHERE role='request' AND rsp_role='response' AND device=rsp_device AND (fc=rsp_fc OR rsp_fc=fc+128)),
e AS (SELECT b.* EXCLUDE (req_off, req_ts, rsp_ts), p.req_off, p.req_ts, p.rsp_ts FROM p JOIN b ON b.capture_id=p.capture_id
      AND b.req_off=CASE WHEN b.lost AND p.kind='write' THEN p.req_off-8 ELSE p.req_off END)
"""


def sql(body: str) -> str:
    return f"WITH {SQL_EXCHANGES} {body}"
