"""Named queries over the given tables, each with the SQL that must agree with it.

``events`` stands in for a keyed telemetry stream (users as captures, event types as
states, ``props.k`` as a register); ``lineitem`` supplies register words and, through
``table_capture``, a whole bus capture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.functions.binary import (
    ascii_text,
    byte_bytes,
    crc16,
    hex_word,
    to_signed16,
    u8,
    u16,
    valid_crc,
    word_bytes,
)
from wiretide.functions.scalar import (
    bit,
    duration_ms,
    register_label,
    split_word,
    stacked_bit,
    timestamp_text,
)
from wiretide.operators import changes, dims, stats, telemetry, throttle
from wiretide.operators.asof import asof_join, join_streams
from wiretide.operators.decode import register_rows, register_updates, wire_table, words_binary
from wiretide.operators.framing import frames_only
from wiretide.operators.layouts import EXTENDED, STANDARD
from wiretide.operators.overrides import override_frames
from wiretide.operators.pairing import pair_latest, pair_next, pair_pending, pair_run
from wiretide.operators.redact import redact_frames, redact_hex, redact_table, redact_text
from wiretide.operators.registers import (
    FieldColumn,
    filter_registers,
    match_specs,
    parse_spec,
    register_keys,
    state_intervals,
    watch_register,
)
from wiretide.operators.runs import Run, run
from wiretide.plans import report
from wiretide.plans import table_capture as capture
from wiretide.plans.pipelines import framed, frames_from_lines, state_table
from wiretide.sinks.files import register_log_rows
from wiretide.sources.hexdump import format_hexdump, rejected_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """events with the register-like integer ``k``."""
    return events(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


ORDER = ["ts", "event_id"]
USER = ["user_id"]
SQL_K = "SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events"
BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def typed(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("event_type") == name)


# -- joins by time ----------------------------------------------------------------


def _click_views(spark, folder, by, tolerance=None):
    ev = events(spark, folder)
    left = typed(ev, "click").select("event_id", "user_id", "ts")
    right = typed(ev, "view").select("user_id", "ts", F.col("event_id").alias("poll_id"), F.col("value").alias("poll_value"))
    if not by:
        right = right.drop("user_id")
    return asof_join(left, right, by=by, left_seq="event_id", right_seq="poll_id", tolerance_seconds=tolerance, right_ts="poll_ts")


_ASOF = """SELECT c.event_id, c.user_id, c.ts, {cols} FROM (SELECT * FROM events WHERE event_type='click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') v ON {by} c.ts >= v.ts"""


@query(_ASOF.format(cols="v.event_id AS poll_id, v.value AS poll_value, v.ts AS poll_ts", by="c.user_id = v.user_id AND"))
def asof_poll(spark, folder):
    return _click_views(spark, folder, USER)


@query(_ASOF.format(cols="v.event_id AS poll_id, v.value AS poll_value, v.ts AS poll_ts", by=""))
def asof_global(spark, folder):
    return _click_views(spark, folder, [])


_FRESH = "c.ts - v.ts <= INTERVAL 6 HOUR"


@query(_ASOF.format(
    cols=", ".join(f"CASE WHEN {_FRESH} THEN v.{c} END AS {a}" for c, a in (("event_id", "poll_id"), ("value", "poll_value"), ("ts", "poll_ts"))),
    by="c.user_id = v.user_id AND"))
def asof_tolerance(spark, folder):
    return _click_views(spark, folder, USER, 6 * 3600)


@query("""SELECT c.event_id, c.user_id, c.ts, 'signup_' || CAST(s.event_id AS VARCHAR) AS active_tag,
CASE WHEN s.event_id IS NOT NULL THEN 'manual' END AS tag_source
FROM (SELECT * FROM events WHERE event_type='view') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='signup') s ON c.user_id = s.user_id AND c.ts >= s.ts""")
def active_tag(spark, folder):
    ev = events(spark, folder)
    wire = typed(ev, "view").select("user_id", "event_id", "ts")
    tags = typed(ev, "signup").select(
        "user_id", "ts", F.concat(F.lit("signup_"), F.col("event_id").cast("string")).alias("tag"),
        F.lit("manual").alias("source"), F.col("event_id").alias("seq"),
    )
    return join_streams(wire, None, tags, by=USER, seq={"wire": "event_id", "tags": "seq"})


@query("""SELECT c.event_id, c.user_id, c.ts, v.value AS tcp_value, CAST(NULL AS VARCHAR) AS active_tag, CAST(NULL AS VARCHAR) AS tag_source
FROM (SELECT * FROM events WHERE event_type='click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def polls_without_tags(spark, folder):
    ev = events(spark, folder)
    wire = typed(ev, "click").select("user_id", "event_id", "ts")
    polls = typed(ev, "view").select("user_id", "ts", F.col("value").alias("tcp_value"), F.col("event_id").alias("seq"))
    return join_streams(wire, polls, None, by=USER, seq={"wire": "event_id", "polls": "seq"})


# -- state ------------------------------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT event_id, user_id, ts, " + ", ".join(
    f"last_value(CASE WHEN event_type='{t}' THEN value END IGNORE NULLS) OVER (w {RUNNING}) AS last_{t}" for t in TYPES)
    + f" FROM events WINDOW w AS ({BY_USER})")
def last_known(spark, folder):
    columns = {f"last_{t}": F.when(F.col("event_type") == t, F.col("value")) for t in TYPES}
    held = run(events(spark, folder), USER, ORDER).last_known(columns).done()
    return held.select("event_id", "user_id", "ts", *columns)


def _level(spark, folder):
    return events(spark, folder).select("event_id", "user_id", "ts", F.floor(F.col("value") / 25).cast("int").alias("level"))


_LEVEL = "SELECT event_id, user_id, ts, CAST(floor(value/25) AS INTEGER) AS level FROM events"


@query(f"""SELECT event_id, user_id, ts, level FROM (SELECT *, row_number() OVER w AS rn, lag(level) OVER w AS before
FROM ({_LEVEL}) WINDOW w AS ({BY_USER})) WHERE rn = 1 OR level IS DISTINCT FROM before""")
def dedupe_state(spark, folder):
    return throttle.drop_repeats(_level(spark, folder), USER, ORDER, ["level"])


def _fold_sql(keep: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER ({BY_USER}) AS rn FROM ({_LEVEL})),
w AS (SELECT user_id, rn, event_id, ts, level, level AS last_level, ts AS last_ts, true AS kept FROM e WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, ts, level, CASE WHEN k THEN level ELSE last_level END, CASE WHEN k THEN ts ELSE last_ts END, k
  FROM (SELECT e.*, w.last_level, w.last_ts, {keep} AS k FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1))
SELECT event_id, user_id, ts, level FROM w WHERE kept"""


@query(_fold_sql("(e.level <> w.last_level AND e.ts - w.last_ts >= INTERVAL 1 DAY)"))
def min_gap(spark, folder):
    return throttle.min_gap(_level(spark, folder), USER, ORDER, "ts", ["level"], 86400)


@query(_fold_sql("(e.ts - w.last_ts >= INTERVAL 12 HOUR)"))
def rate_limit(spark, folder):
    return throttle.rate_limit(_level(spark, folder), USER, ORDER, "ts", 43200)


_CHANGES = f"SELECT *, lag(event_type) OVER ({BY_USER}) AS before FROM events"


@query(f"SELECT event_id, user_id, ts, before AS prev_value, event_type AS new_value FROM ({_CHANGES}) WHERE before <> event_type")
def state_changes(spark, folder):
    found = changes.changes(events(spark, folder), USER, ORDER, "event_type")
    return found.select("event_id", "user_id", "ts", "prev_value", "new_value")


@query(f"""SELECT user_id, ts, 'auto:event_type:' || before || '->' || event_type AS tag, 'auto' AS source
FROM ({_CHANGES}) WHERE before <> event_type""")
def auto_tags(spark, folder):
    return changes.auto_tags(events(spark, folder), USER, ORDER, "event_type")


@query(f"""SELECT event_id, user_id, ts, k, k - lag(k) OVER ({BY_USER}) AS delta FROM ({SQL_K})""")
def first_difference(spark, folder):
    return changes.difference(readings(spark, folder), USER, ORDER, "k").select("event_id", "user_id", "ts", "k", "delta")


_FLIPS = f"""SELECT event_id, user_id, ts, CAST(b AS INTEGER) AS bit, CAST((k >> b) & 1 AS INTEGER) AS state
FROM (SELECT *, lag(k) OVER ({BY_USER}) AS before FROM ({SQL_K})), (SELECT unnest(range(8)) AS b)
WHERE ((k >> b) & 1) <> ((before >> b) & 1)"""


@query(_FLIPS)
def bit_transitions(spark, folder):
    found = changes.bit_transitions(readings(spark, folder), USER, ORDER, "k")
    return found.select("event_id", "user_id", "ts", "bit", "state")


def _names_sql(names: dict[int, str]) -> str:
    return "(VALUES " + ", ".join(f"({b}, '{n}')" for b, n in names.items()) + ") AS d(bit, name)"


@query(f"""SELECT f.bit, coalesce(name, '?') AS name, count(*) AS n FROM ({_FLIPS}) f
LEFT JOIN {_names_sql({b: n for b, n in dims.PACK_ALARM_BITS.items() if b != 5})} ON d.bit = f.bit GROUP BY 1, 2""")
def alarm_names(spark, folder):
    names = {b: n for b, n in dims.PACK_ALARM_BITS.items() if b != 5}  # bit 5 shows the default
    found = changes.bit_transitions(readings(spark, folder), USER, ORDER, "k")
    return dims.with_bit_names(found.groupBy("bit").agg(F.count("*").alias("n")), names).select("bit", "name", "n")


@query(f"""SELECT CAST(b AS INTEGER) AS bit, name, count(*) AS n FROM ({SQL_K}), (SELECT unnest(range(8)) AS b),
{_names_sql(dims.HR20_ALARM_BITS)} WHERE d.bit = b AND ((k >> b) & 1) = 1 GROUP BY 1, 2""")
def raised_alarms(spark, folder):
    lanes = F.array(*[F.when(bit(F.col("k"), b) == 1, b) for b in range(8)])
    raised = readings(spark, folder).select(F.explode(F.array_compact(lanes)).alias("bit"))
    return dims.with_bit_names(raised.groupBy("bit").agg(F.count("*").alias("n")), dims.HR20_ALARM_BITS).select("bit", "name", "n")


@query(f"""SELECT event_id, user_id, ts, CASE WHEN k IS NOT NULL THEN list_aggregate(list_filter([{', '.join(f"CASE WHEN (k >> {b}) & 1 = 1 THEN '{n}' END" for b, n in dims.PACK_STATUS_BITS.items())}], lambda n: n IS NOT NULL), 'string_agg', '+') END AS status FROM ({SQL_K})""")
def status_flags(spark, folder):
    """All raised bits of a status byte by name."""
    names = F.array_join(telemetry.status_names(F.col("k"), dims.PACK_STATUS_BITS), "+")
    return readings(spark, folder).select("event_id", "user_id", "ts", F.when(names != "", names).alias("status"))


@query(f"""SELECT f.bit, c.before AS prev_value, c.event_type AS new_value, count(*) AS n FROM ({_FLIPS}) f
JOIN (SELECT * FROM ({_CHANGES}) WHERE before <> event_type) c
ON c.user_id = f.user_id AND c.ts BETWEEN f.ts - INTERVAL 1 HOUR AND f.ts + INTERVAL 1 HOUR GROUP BY 1, 2, 3""")
def coincident_changes(spark, folder):
    flips = changes.bit_transitions(readings(spark, folder), USER, ORDER, "k")
    reported = changes.changes(events(spark, folder), USER, ORDER, "event_type")
    return changes.coincidences(flips, reported, USER, 3600)


@query(f"""SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS missed FROM (
SELECT *, sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) OVER ({BY_USER} {RUNNING}) AS g FROM events)
WHERE event_type <> 'purchase' GROUP BY user_id, g HAVING count(*) >= 10""")
def missed_polls(spark, folder):
    return changes.islands(events(spark, folder), USER, ORDER, F.col("event_type") != "purchase", "ts", 10)


@query(f"""SELECT event_id, user_id, ts, value,
last_value(CASE WHEN value > 2 AND value < 150 THEN value END IGNORE NULLS) OVER ({BY_USER} {RUNNING}) AS held FROM events""")
def envelope_hold(spark, folder):
    held = telemetry.hold_good(events(spark, folder), USER, ORDER, "value", telemetry.within(F.col("value"), (2, 150)))
    return held.select("event_id", "user_id", "ts", "value", "held")


@query(f"""SELECT event_id, user_id, ts, held, (epoch_us(ts) - epoch_us(t)) / 1000000.0 AS age_seconds,
(epoch_us(ts) - epoch_us(t)) / 1000000.0 > 86400 AS stale FROM (SELECT *,
last_value(CASE WHEN event_type='view' THEN value END IGNORE NULLS) OVER w AS held,
last_value(CASE WHEN event_type='view' THEN ts END IGNORE NULLS) OVER w AS t
FROM events WINDOW w AS ({BY_USER} {RUNNING}))""")
def stale_age(spark, folder):
    ev = events(spark, folder).withColumn("seen", F.when(F.col("event_type") == "view", F.col("value")))
    held = telemetry.hold_with_age(ev, USER, ORDER, "seen", "ts", 86400)
    return held.select("event_id", "user_id", "ts", "held", "age_seconds", "stale")


# -- pairs, cadence, latency on events ---------------------------------------------


def _answered(spark, folder):
    ev = events(spark, folder).select("event_id", "user_id", "ts", "event_type")
    nxt = {"rsp_ts": F.col("ts"), "rsp_type": F.col("event_type"), "rsp_id": F.col("event_id")}
    led = pair_next(ev, USER, ORDER, F.col("event_type") == "click", nxt)
    return led.where(F.col("rsp_type").isin("purchase", "error"))


_PAIRS = f"""SELECT event_id, user_id, ts, rsp_id, rsp_type, rsp_ts, (epoch_us(rsp_ts) - epoch_us(ts)) / 1000.0 AS ms FROM (
SELECT *, lead(event_id) OVER w AS rsp_id, lead(event_type) OVER w AS rsp_type, lead(ts) OVER w AS rsp_ts
FROM events WINDOW w AS ({BY_USER})) WHERE event_type='click' AND rsp_type IN ('purchase', 'error')"""


@query(f"SELECT event_id, user_id, ts, rsp_id, rsp_type, rsp_ts FROM ({_PAIRS})")
def pair_next_event(spark, folder):
    return _answered(spark, folder).select("event_id", "user_id", "ts", "rsp_id", "rsp_type", "rsp_ts")


def _r(column: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(column)


@query(f"""SELECT rsp_type, count(*) AS n, round(avg(ms), 6) AS avg_ms, round(min(ms), 6) AS min_ms, round(max(ms), 6) AS max_ms,
round(median(ms), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM ({_PAIRS}) GROUP BY rsp_type""")
def latency_by_type(spark, folder):
    timed = _answered(spark, folder).withColumn("ms", duration_ms(F.col("ts"), F.col("rsp_ts")))
    aggregates = [F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")]
    rows = stats.with_quantiles(timed, ["rsp_type"], "ms", aggregates, {"p50": 0.5, "p95": 0.95})
    return rows.select("rsp_type", "n", *[_r(c) for c in ("avg_ms", "min_ms", "max_ms", "p50", "p95")])


@query("""SELECT user_id, event_type, count(*) AS requests, avg(gap) / 1000.0 AS avg_ms, min(gap) / 1000.0 AS min_ms, max(gap) / 1000.0 AS max_ms
FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS gap FROM events)
GROUP BY 1, 2""")
def cadence_by_type(spark, folder):
    by = ["user_id", "event_type"]
    return changes.gap_summary(changes.gap_us(events(spark, folder), by, ORDER, "ts"), by)


QUEUE = 3


@query(f"""WITH RECURSIVE f AS (SELECT user_id, event_id AS off, ts, event_type IN ('click', 'view') AS asks, CAST(1 + event_id % 3 AS INTEGER) AS n,
  CAST(event_id % 1000 AS INTEGER) AS addr, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, []::STRUCT(off BIGINT, ts TIMESTAMP, addr INTEGER, n INTEGER)[] AS q, NULL::STRUCT(off BIGINT, ts TIMESTAMP, addr INTEGER, n INTEGER) AS hit,
    NULL::BIGINT AS off, NULL::TIMESTAMP AS ts FROM f
  UNION ALL SELECT user_id, rn, CASE WHEN asks THEN list_append(CASE WHEN len(q) >= {QUEUE} THEN q[len(q)-{QUEUE - 2}:] ELSE q END, mine) WHEN p > 0 THEN list_concat(q[:p-1], q[p+1:]) ELSE q END,
    CASE WHEN NOT asks AND p > 0 THEN q[p] END, off, ts
  FROM (SELECT f.user_id, f.rn, f.off, f.ts, f.asks, w.q, {{'off': f.off, 'ts': CAST(f.ts AS TIMESTAMP), 'addr': f.addr, 'n': f.n}} AS mine,
    coalesce(list_position(list_transform(w.q, lambda x: x.n), f.n), 0) AS p FROM w JOIN f ON f.user_id = w.user_id AND f.rn = w.rn + 1))
SELECT user_id, hit.off AS req_off, epoch_us(hit.ts) AS req_us, off AS rsp_off, epoch_us(ts) AS rsp_us, 1 AS device, 3 AS fc, hit.addr AS addr, hit.n AS "count" FROM w WHERE hit IS NOT NULL""")
def pending_events(spark, folder):
    """A queue of open requests per user, small enough to push old ones out: clicks and views ask,
    other events answer the oldest request of their size."""
    ev, n = events(spark, folder), (1 + F.col("event_id") % 3).cast("int")
    raw = F.concat(byte_bytes(F.lit(1)), byte_bytes(F.lit(3)), word_bytes(F.col("event_id") % 1000), word_bytes(n))
    role = F.when(F.col("event_type").isin("click", "view"), "request").otherwise("response")
    exchanged = ev.select("user_id", F.col("event_id").alias("off"), "ts", role.alias("role"), F.lit(1).alias("device"), F.lit(3).alias("fc"), (2 * n + 5).alias("len"), raw.alias("raw"))
    return pair_pending(exchanged, USER, limit=QUEUE)


# -- statistics ---------------------------------------------------------------------


@query(f"""SELECT delta, count(*) AS n FROM (SELECT k - lag(k) OVER ({BY_USER}) AS delta FROM ({SQL_K}))
WHERE delta IS NOT NULL GROUP BY delta ORDER BY n DESC, delta LIMIT 10""")
def delta_top10(spark, folder):
    return stats.value_counts(changes.difference(readings(spark, folder), USER, ORDER, "k"), "delta", 10)


@query(f"""SELECT user_id, n_distinct, CASE WHEN n_distinct <= 1 THEN 'constant' WHEN n_distinct <= 3 THEN 'state'
WHEN n_distinct <= 10 THEN 'slow' WHEN n_distinct >= 85 THEN 'fast' ELSE 'medium' END AS kind
FROM (SELECT user_id, count(DISTINCT k) AS n_distinct FROM ({SQL_K}) GROUP BY user_id)""")
def distinct_profile(spark, folder):
    return stats.distinct_profile(readings(spark, folder), USER, "k")


@query(f"""SELECT user_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy_bits FROM (
SELECT user_id, k, count(*) AS c FROM ({SQL_K}) GROUP BY 1, 2) GROUP BY user_id""")
def entropy_k(spark, folder):
    return stats.entropy(readings(spark, folder), USER, "k").select("user_id", _r("entropy_bits"))


@query(f"""SELECT user_id, count(*) AS steps, round(avg(CASE WHEN ((delta % 100) + 100) % 100 = 1 THEN 1.0 ELSE 0.0 END), 6) AS share
FROM (SELECT user_id, k - lag(k) OVER ({BY_USER}) AS delta FROM ({SQL_K})) WHERE delta IS NOT NULL GROUP BY user_id""")
def counter_share(spark, folder):
    deltas = changes.difference(readings(spark, folder), USER, ORDER, "k")
    return stats.counter_share(deltas, USER, modulus=100).select("user_id", "steps", _r("share"))


@query("""SELECT tag, count(*) AS n, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std, count(DISTINCT value) AS n_distinct
FROM (SELECT v.value, CASE WHEN s.event_id IS NOT NULL THEN 'phase_' || CAST(s.event_id % 4 AS VARCHAR) END AS tag
FROM (SELECT * FROM events WHERE event_type='view') v
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='signup') s ON v.user_id = s.user_id AND v.ts >= s.ts) GROUP BY tag""")
def per_tag_stats(spark, folder):
    ev = events(spark, folder)
    tags = typed(ev, "signup").select(
        "user_id", "ts", F.concat(F.lit("phase_"), (F.col("event_id") % 4).cast("string")).alias("tag"), F.col("event_id").alias("seq"))
    tagged = asof_join(typed(ev, "view").select("user_id", "event_id", "ts", "value"), tags, by=USER, right_columns=["tag"], left_seq="event_id", right_seq="seq")
    return stats.per_tag(tagged, "tag", "value").select("tag", "n", "min", "max", _r("std"), "n_distinct")


_DESCRIBE = """count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75 FROM events"""


@query(f"SELECT {_DESCRIBE}")
def describe_value(spark, folder):
    rows = stats.describe(events(spark, folder), "value")
    return rows.select("count", _r("mean"), _r("std"), "min", "max", _r("p25"), _r("p50"), _r("p75"))


@query(f"SELECT event_type, {_DESCRIBE} GROUP BY event_type")
def describe_by_type(spark, folder):
    rows = stats.describe(events(spark, folder), "value", ["event_type"])
    return rows.select("event_type", "count", _r("mean"), _r("std"), "min", "max", _r("p25"), _r("p50"), _r("p75"))


@query("""SELECT count(*) AS n, round(corr(l_quantity * 100, round(l_extendedprice / 20)), 6) AS correlation,
round(avg(abs(l_quantity * 100 - round(l_extendedprice / 20))), 6) AS mean_abs_residual,
round(avg(CASE WHEN l_quantity * 100 = round(l_extendedprice / 20) THEN 1.0 ELSE 0.0 END), 6) AS exact_share FROM lineitem""")
def corr_pair(spark, folder):
    li = table(spark, folder, "lineitem")
    rows = stats.compare_columns(li, F.col("l_quantity") * 100, F.round(F.col("l_extendedprice") / 20))
    return rows.select("n", _r("correlation"), _r("mean_abs_residual"), _r("exact_share"))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr_l_extendedprice, round(corr(l_quantity, l_discount), 6) AS corr_l_discount,
round(corr(l_quantity, l_tax), 6) AS corr_l_tax FROM lineitem GROUP BY l_returnflag""")
def correlations(spark, folder):
    rows = stats.correlations(table(spark, folder, "lineitem"), "l_quantity", ["l_extendedprice", "l_discount", "l_tax"], ["l_returnflag"])
    return rows.select("l_returnflag", *[_r(f"corr_{c}") for c in ("l_extendedprice", "l_discount", "l_tax")])


@query("""SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2""")
def resample_avg(spark, folder):
    rows = telemetry.resample(events(spark, folder), ["event_type"], "ts", "1 hour", {"n": F.count("*"), "value": F.avg("value")})
    return rows.select("event_type", "ts", "n", _r("value"))


@query("""SELECT ts, count(*) AS packs, round(sum(amps), 6) AS amps, min_by(volts, user_id) FILTER (volts IS NOT NULL) AS volts, min(k) AS k, max(hot) AS hot
FROM (SELECT user_id, date_trunc('day', ts) AS ts, max_by(value, (ts, event_id)) AS amps, max_by(event_id, (ts, event_id)) AS volts,
max_by(k, (ts, event_id)) AS k, max_by(value, (ts, event_id)) AS hot FROM (""" + SQL_K + """) GROUP BY 1, 2) GROUP BY ts""")
def multi_pack(spark, folder):
    rows = readings(spark, folder).withColumns({"amps": F.col("value"), "volts": F.col("event_id"), "hot": F.col("value")})
    packs = telemetry.multi_pack(rows, [], "ts", "1 day", order=F.struct("ts", "event_id"), device="user_id",
                                 total=["amps"], one=["volts"], lowest=["k"], highest=["hot"])
    return packs.select("ts", "packs", _r("amps"), "volts", "k", "hot")


# -- register words from lineitem ----------------------------------------------------


def registers(spark, folder):
    """Long register rows: one per lineitem."""
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", (1 + F.col("l_suppkey") % 5).cast("int").alias("device"),
        (3 + F.col("l_linenumber") % 2).cast("int").alias("fc"), (F.col("l_partkey") % 60).cast("int").alias("reg"),
        F.pmod(F.col("l_orderkey") * 7 + F.col("l_partkey"), F.lit(65536)).cast("int").alias("value"),
    )


_REGS = """SELECT l_orderkey, l_linenumber, CAST(1 + l_suppkey % 5 AS INTEGER) AS device, CAST(3 + l_linenumber % 2 AS INTEGER) AS fc,
CAST(l_partkey % 60 AS INTEGER) AS reg, CAST((l_orderkey*7 + l_partkey) % 65536 AS INTEGER) AS value FROM lineitem"""
SPECS = ["1:3:0x10", "w@*:4:20", "b@2:*:31", "sw@3:3:*"]


@query(f"""SELECT * FROM ({_REGS}) WHERE (device=1 AND fc=3 AND reg=16) OR (fc=4 AND reg=20) OR (device=2 AND reg=31) OR (device=3 AND fc=3)""")
def register_filter(spark, folder):
    return filter_registers(registers(spark, folder), [parse_spec(s) for s in SPECS])


@query(f"""WITH keys AS (SELECT DISTINCT device, fc, reg FROM ({_REGS})),
specs AS (SELECT * FROM (VALUES ('w', 1, 3, CAST(NULL AS INTEGER), 1), ('sw', NULL, 4, 59, 1), ('b', 2, NULL, 31, 2)) s(mode, d, f, r, o)),
fields AS (SELECT DISTINCT device, fc, reg, o AS byte_offset, mode FROM keys JOIN specs ON (d IS NULL OR d=device) AND (f IS NULL OR f=fc) AND (r IS NULL OR r=reg))
SELECT CAST(device AS INTEGER) AS device, fc, reg, byte_offset, mode FROM fields f WHERE EXISTS (SELECT 1 FROM keys k WHERE k.device=f.device AND k.fc=f.fc AND k.reg=f.reg + byte_offset//2)
AND EXISTS (SELECT 1 FROM keys k WHERE k.device=f.device AND k.fc=f.fc AND k.reg=f.reg + (byte_offset+1)//2)""")
def matched_fields(spark, folder):
    specs = [parse_spec(s) for s in ("w@1:3:*+1", "sw@*:4:59+1", "b@2:*:31+2")]
    return match_specs(register_keys(registers(spark, folder)), specs)


@query(f"""SELECT l_orderkey, l_linenumber, value, CAST((value & 255) * 256 + (l_orderkey % 65536 >> 8) AS INTEGER) AS straddle,
CAST(CASE WHEN value >= 32768 THEN value - 65536 ELSE value END AS INTEGER) AS signed, CAST((value >> 5) & 1 AS INTEGER) AS flag, CAST(6 + ((value >> 5) & 1) AS INTEGER) AS lane,
printf('0x%04X', value) AS hex, 'device_' || lpad(CAST(device AS VARCHAR), 3, '0') || '_fc_' || lpad(CAST(fc AS VARCHAR), 2, '0') || '_reg_' || lpad(CAST(reg AS VARCHAR), 5, '0') AS name
FROM ({_REGS})""")
def split_words(spark, folder):
    value, second = F.col("value"), F.pmod(F.col("l_orderkey"), F.lit(65536)).cast("int")
    return registers(spark, folder).select(
        "l_orderkey", "l_linenumber", "value", split_word(value, second, 1).alias("straddle"), to_signed16(value).alias("signed"),
        bit(value, 5).alias("flag"), stacked_bit(value, 5, 3).alias("lane"), hex_word(value).alias("hex"),
        register_label(F.col("device"), F.col("fc"), F.col("reg")).alias("name"),
    )


@query("""SELECT o_orderkey, CAST(o_orderkey % 65536 AS INTEGER) AS word, CAST(o_custkey % 256 AS INTEGER) AS byte,
CAST(CASE WHEN (o_orderkey*13) % 65536 >= 32768 THEN (o_orderkey*13) % 65536 - 65536 ELSE (o_orderkey*13) % 65536 END AS INTEGER) AS signed FROM orders""")
def binary_words(spark, folder):
    data = F.concat(word_bytes(F.col("o_orderkey") % 65536), byte_bytes(F.col("o_custkey") % 256), word_bytes((F.col("o_orderkey") * 13) % 65536))
    packed = table(spark, folder, "orders").select("o_orderkey", data.alias("data"))
    return packed.select("o_orderkey", u16("data", 0).alias("word"), u8("data", 2).alias("byte"), to_signed16(u16("data", 3)).alias("signed"))


@query("""SELECT o_orderkey, round(o_totalprice / 100, 6) AS amps, round(o_totalprice / 1000, 6) AS volts,
round(CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderkey * 100.0 / (o_custkey % 7) END, 6) AS soc,
CASE o_orderkey % 4 WHEN 1 THEN 'idle' WHEN 2 THEN 'charge' WHEN 3 THEN 'discharge' END AS direction,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM orders""")
def unit_scale(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        "o_orderkey", F.round(F.col("o_totalprice") / 100, 6).alias("amps"), F.round(F.col("o_totalprice") / 1000, 6).alias("volts"),
        F.round(telemetry.state_of_charge(F.col("o_orderkey"), F.col("o_custkey") % 7), 6).alias("soc"),
        telemetry.direction(F.col("o_orderkey") % 4).alias("direction"), timestamp_text(F.col("o_orderdate")).alias("stamp"),
    )


@query(f"""WITH edits AS (SELECT CAST(1 + s_suppkey % 5 AS INTEGER) AS device, CAST(3 + s_suppkey % 2 AS INTEGER) AS fc, CAST(s_suppkey % 20 AS INTEGER) AS reg,
s_suppkey AS edit_seq, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(s_suppkey * 3 AS INTEGER) END AS value FROM supplier),
o AS (SELECT device, fc, reg, value FROM edits e WHERE edit_seq = (SELECT max(edit_seq) FROM edits i WHERE i.device=e.device AND i.fc=e.fc AND i.reg=e.reg) AND value IS NOT NULL)
SELECT l_orderkey, l_linenumber, r.device, r.fc, r.reg, coalesce(o.value, r.value) AS value, coalesce(o.value, r.value) <> r.value AS changed
FROM ({_REGS}) r LEFT JOIN o ON o.device=r.device AND o.fc=r.fc AND o.reg=r.reg""")
def whatif_override(spark, folder):
    s = F.col("s_suppkey")
    edits = table(spark, folder, "supplier").select(
        (1 + s % 5).cast("int").alias("device"), (3 + s % 2).cast("int").alias("fc"), (s % 20).cast("int").alias("reg"),
        s.alias("edit_seq"), F.when(s % 11 != 0, (s * 3).cast("int")).alias("value"))
    return dims.apply_overrides(registers(spark, folder), dims.settle_overrides(edits))



def _crc_sql(hexed: str) -> str:
    """CRC of a hex string, bit by bit, as a list reduction."""
    size = f"length({hexed})//2"
    byte = f"CAST('0x' || substr({hexed}, CAST(2*i-1 AS BIGINT), 2) AS INTEGER)"
    shift = "(CASE WHEN r % 2 = 1 THEN xor(r // 2, 40961) ELSE r // 2 END)"
    folded = f"list_reduce(list_concat([xor(acc, b)], [0,0,0,0,0,0,0,0]), lambda r, z: {shift})"
    return f"list_reduce(list_concat([65535], list_transform(range(1, {size}+1), lambda i: {byte})), lambda acc, b: {folded})"


@query(f"""SELECT l_orderkey, l_linenumber, body, CAST({_crc_sql('body')} AS INTEGER) AS crc, true AS sealed_ok FROM (
SELECT l_orderkey, l_linenumber, printf('%02X03%04X%04X', CAST(1 + l_suppkey % 247 AS INTEGER), CAST(l_partkey % 65536 AS INTEGER), CAST(l_quantity AS INTEGER))
|| CASE WHEN l_linenumber % 2 = 0 THEN 'FF' ELSE '' END AS body FROM lineitem)""")
def crc_check(spark, folder):
    li = table(spark, folder, "lineitem")
    body = F.concat(byte_bytes(1 + F.col("l_suppkey") % 247), byte_bytes(F.lit(3)), word_bytes(F.col("l_partkey") % 65536), word_bytes(F.col("l_quantity")),
                    F.when(F.col("l_linenumber") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    rows = li.select("l_orderkey", "l_linenumber", body.alias("raw")).withColumn("crc", crc16("raw"))
    framed = F.concat("raw", byte_bytes(F.col("crc") % 256), byte_bytes(F.shiftright("crc", 8)))
    checked = rows.withColumn("framed", framed).withColumn("sealed_ok", valid_crc("framed"))
    return checked.select("l_orderkey", "l_linenumber", F.hex("raw").alias("body"), "crc", "sealed_ok")


_HEX8 = "printf('%04X%04X%04X', CAST(o_orderkey % 65536 AS INTEGER), CAST(o_custkey % 65536 AS INTEGER), CAST((o_orderkey*31) % 65536 AS INTEGER)) || CASE WHEN o_orderkey % 3 = 0 THEN '4142434445464748494A4B4C4D4E' ELSE '' END"


@query(f"""WITH f AS (SELECT o_orderkey, 'c' || CAST(o_custkey % 3 AS VARCHAR) AS capture_id, TIMESTAMP '2026-01-01' + to_milliseconds(o_orderkey) AS ts, {_HEX8} AS h FROM orders),
p AS (SELECT *, CAST(sum(length(h)//2) OVER (PARTITION BY capture_id ORDER BY o_orderkey) - length(h)//2 AS BIGINT) AS base FROM f),
l AS (SELECT *, CAST(unnest(range(0, length(h)//2, 16)) AS INTEGER) AS piece FROM p),
q AS (SELECT *, substr(h, piece*2+1, 32) AS part FROM l),
b AS (SELECT *, list_transform(range(0, length(part)//2), lambda i: substr(part, CAST(i*2+1 AS BIGINT), 2)) AS bytes FROM q)
SELECT capture_id, o_orderkey, piece, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(CAST(epoch_ms(ts) % 1000 AS INTEGER) AS VARCHAR), 3, '0') || '  ' || printf('%08x', base + piece) || '  '
|| rpad(array_to_string(bytes, ' ') || ' ', 48, ' ') || ' |' || array_to_string(list_transform(bytes, lambda x: CASE WHEN CAST('0x' || x AS INTEGER) BETWEEN 32 AND 126 THEN chr(CAST('0x' || x AS INTEGER)) ELSE '.' END), '') || '|' AS value FROM b""")
def hexdump_lines(spark, folder):
    key = F.col("o_orderkey")
    tail = F.when(key % 3 == 0, F.unhex(F.lit("4142434445464748494A4B4C4D4E"))).otherwise(F.unhex(F.lit("")))
    data = F.concat(word_bytes(key % 65536), word_bytes(F.col("o_custkey") % 65536), word_bytes((key * 31) % 65536), tail)
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(key / F.lit(1000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("capture_id"), "o_orderkey", at.alias("ts"), data.alias("bytes"))
    return format_hexdump(rows, ["o_orderkey"])


# -- redaction ----------------------------------------------------------------------

SERIALS = ["ention", "theren"]
IPS = ["97.51.17.173", "161.17.88.162", "194.209.21.243", "12.84.156.107"]


def _hide_serials_sql(text: str) -> str:
    for s in SERIALS:
        text = f"replace({text}, '{s}', '{'X' * len(s)}')"
    return text


def _hide_ips_sql(text: str) -> str:
    for ip in sorted(IPS, key=lambda i: (-len(i), i)):
        dotted = ip.replace(".", "[.]")
        text = f"regexp_replace({text}, '(^|[^0-9.]|[^0-9][.])({dotted})($|[^0-9.]|[.]$|[.][^0-9])', '\\1X.X.X.X\\3', 'g')"
    return text


@query(f"SELECT doc_id, {_hide_ips_sql(_hide_serials_sql('text'))} AS text FROM documents")
def redact_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", redact_text(F.col("text"), SERIALS, IPS).alias("text"))


_NAME_HEX = "rtrim(regexp_replace(hex(c_name), '(..)', '\\1 ', 'g'))"


@query(f"""SELECT c_custkey, replace({_NAME_HEX}, '30 30 30 31', 'XX XX XX XX') AS upper,
replace(lower({_NAME_HEX}), '30 30 30 31', 'XX XX XX XX') AS lower FROM customer""")
def redact_spaced_hex(spark, folder):
    spaced = F.rtrim(F.regexp_replace(F.hex("c_name"), "(..)", "$1 "))
    return table(spark, folder, "customer").select(
        "c_custkey", redact_text(spaced, ["0001"]).alias("upper"), redact_text(F.lower(spaced), ["0001"]).alias("lower"))


@query("""SELECT c_custkey, hex(replace(c_name, '0012', 'XXXX')) AS data FROM customer""")
def redact_bytes(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("data"))
    return rows.select("c_custkey", F.hex(redact_hex(F.col("data"), ["0012"])).alias("data"))


@query("""SELECT s_suppkey, replace(s_name, 'Supplier', 'XXXXXXXX') AS s_name, s_nationkey, hex(replace(s_name, 'Supplier', 'XXXXXXXX')) AS raw FROM supplier""")
def redact_columns(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_name").cast("binary").alias("raw"))
    return redact_table(rows, ["Supplier"]).withColumn("raw", F.hex("raw"))


# -- a whole bus capture -------------------------------------------------------------

_FRAMED: dict[tuple[str, str], Run] = {}


def walked(spark: SparkSession, folder: str) -> Run:
    """The capture's log, parsed and framed: laid out and stored once in a session, like the landing
    table of a site, for all queries that ask something of its frames."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FRAMED:
        _FRAMED[key] = framed(capture.log_lines(spark, folder), capture.LINE_KEYS)
    return _FRAMED[key]


def frames(spark: SparkSession, folder: str) -> Run:
    return frames_only(walked(spark, folder))


def pairs(spark: SparkSession, folder: str, exceptions: bool = False) -> Run:
    return pair_run(frames(spark, folder), exceptions=exceptions)


@query(capture.sql("SELECT capture_id, off, ts, role, device, fc, len, swap, CAST(gap AS BIGINT) AS gap FROM f"))
def wire_frames(spark, folder):
    """Encode, write as hexdump text, parse, frame."""
    found = frames_from_lines(capture.log_lines(spark, folder), capture.LINE_KEYS)
    return frames_only(found).select("capture_id", "off", "ts", "role", "device", "fc", "len", "swap", "gap")


_STRICT = "kind <> 'exception'"  # of paired exchanges


@query(capture.sql("""SELECT capture_id, frames, drops, rejected FROM (SELECT capture_id, count(*) AS frames, CAST(sum(gap) AS BIGINT) AS drops FROM f GROUP BY 1)
JOIN (SELECT capture_id, count(*) AS rejected FROM x WHERE l_linenumber=1 GROUP BY 1) USING (capture_id)"""))
def wire_malformed(spark, folder):
    """Torn lines in the log are skipped and counted; frames and dropped bytes stay the same."""
    lines = capture.log_lines(spark, folder)
    first = (F.col("l_linenumber") == 1) & (F.col("flush") == 0) & (F.col("piece") == 0)
    line = F.struct("piece", "value")
    torn = F.struct(F.lit(90).alias("piece"), F.substring("value", 1, 40).alias("value"))
    head = [c for c in capture.LINE_KEYS if c != "piece"]
    both = F.when(first, F.array(line, torn)).otherwise(F.array(line))
    mixed = lines.select("capture_id", *head, F.explode(both).alias("v")).select("capture_id", *head, "v.*")
    found = frames_only(frames_from_lines(mixed, capture.LINE_KEYS)).groupBy("capture_id").agg(F.count("*").alias("frames"), F.sum("gap").alias("drops"))
    return found.join(rejected_lines(mixed).where("rejected > 0").select("capture_id", "rejected"), "capture_id")


@query(capture.sql(f"""SELECT capture_id, count(*) AS frames, CAST(sum(gap) AS BIGINT) AS drops,
round((epoch_us(max_by(ts, off)) - epoch_us(min_by(ts, off))) / 1000000.0, 3) AS span_seconds,
(SELECT count(*) FROM p WHERE p.capture_id=f.capture_id AND rsp_fc=fc) AS pairs FROM f GROUP BY capture_id"""))
def wire_totals(spark, folder):
    totals = report.capture_totals(walked(spark, folder).done(), pairs(spark, folder).done())
    return totals.withColumn("span_seconds", F.round("span_seconds", 3))


@query(capture.sql("SELECT capture_id, role, fc, count(*) AS n FROM f GROUP BY 1, 2, 3"))
def wire_frame_summary(spark, folder):
    return report.frame_summary(frames(spark, folder).done())


def _pairs_sql(where: str) -> str:
    return capture.sql(f"""SELECT capture_id, req_off AS pair_off, device, fc, rsp_fc, req_ts, rsp_ts, addr,
CASE WHEN fc IN (3, 4) THEN "count" END AS "count" FROM p WHERE {where}""")


def _pair_columns(pairs: DataFrame) -> DataFrame:
    return pairs.select("capture_id", "pair_off", "device", "fc", "rsp_fc", "req_ts", "rsp_ts", "addr", "count")


@query(_pairs_sql("rsp_fc = fc"))
def wire_pairs(spark, folder):
    return _pair_columns(pairs(spark, folder).done())


@query(_pairs_sql("true"))
def wire_pairs_with_exceptions(spark, folder):
    return _pair_columns(pairs(spark, folder, exceptions=True).done())


@query(capture.sql("""SELECT capture_id, req_off, req_ts, req_off + 8 AS rsp_off, rsp_ts, device, fc, addr, "count" FROM b
WHERE kind IN ('HR', 'IR1', 'IR2', 'IR3')"""))
def wire_pairs_latest(spark, folder):
    return pair_latest(frames(spark, folder))


def wire_pairs_pending(spark, folder):
    """Open requests queue up: an answer goes to the oldest one it fits."""
    return pair_pending(frames(spark, folder))


QUERIES["wire_pairs_pending"] = wire_pairs_pending


@query(capture.sql(f"""SELECT capture_id, device, fc, addr, "count", count(*) AS requests, round(avg(g), 6) AS avg_ms, min(g) AS min_ms, max(g) AS max_ms FROM (
SELECT *, (epoch_us(req_ts) - epoch_us(lag(req_ts) OVER (PARTITION BY capture_id, device, fc, addr, "count" ORDER BY rn))) / 1000.0 AS g FROM e WHERE {_STRICT} AND fc IN (3, 4)) GROUP BY 1, 2, 3, 4, 5"""))
def wire_cadence(spark, folder):
    rows = report.cadence(pairs(spark, folder))
    return rows.withColumn("avg_ms", F.round("avg_ms", 6))


_LATENCY = f"""SELECT capture_id, device, fc, CASE WHEN fc<>6 THEN addr END AS addr, CASE WHEN fc<>6 THEN "count" END AS "count", count(*) AS n, round(avg(ms), 6) AS avg_ms,
min(ms) AS min_ms, max(ms) AS max_ms, min(req_off) AS first_pair_off, round(median(ms), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95
FROM (SELECT *, (epoch_us(rsp_ts) - epoch_us(req_ts)) / 1000.0 AS ms FROM e WHERE {_STRICT}) GROUP BY 1, 2, 3, 4, 5"""


def _latency(spark, folder):
    rows = report.latency(pairs(spark, folder))
    return rows.withColumns({c: F.round(c, 6) for c in ("avg_ms", "p50", "p95")})


@query(capture.sql(_LATENCY))
def wire_latency(spark, folder):
    return _latency(spark, folder)


@query(capture.sql(f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, first_pair_off) AS INTEGER) AS rank FROM ({_LATENCY})) WHERE rank <= 3"""))
def wire_top_queries(spark, folder):
    return report.top_queries(_latency(spark, folder), top=3)


@query(capture.sql("""SELECT * FROM (SELECT capture_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY off) AS INTEGER) AS rank, ts, device, addr, "count" AS value
FROM f WHERE fc=6 AND role='request') WHERE rank <= 20"""))
def wire_writes(spark, folder):
    return report.writes(frames(spark, folder).done())


@query(capture.sql("""SELECT * FROM (SELECT capture_id, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY req_off) AS INTEGER) AS rank, rsp_ts AS ts, device, 131 AS fc, 2 AS code
FROM b WHERE kind='exception') WHERE rank <= 20"""))
def wire_exceptions(spark, folder):
    return report.exceptions(frames(spark, folder).done())


@query(capture.sql("SELECT capture_id, count(*) FILTER (kind='write') AS writes, count(*) FILTER (kind='exception') AS exceptions FROM b GROUP BY 1"))
def wire_anomaly_counts(spark, folder):
    return report.anomaly_counts(frames(spark, folder).done())


@query(capture.sql(f"""SELECT capture_id, period, count(*) AS blocks, max(d) AS devices, CAST(sum(d) AS BIGINT) AS combinations FROM (
SELECT capture_id, time_bucket(INTERVAL 10 MINUTE, req_ts) AS period, fc, addr, "count", count(DISTINCT device) AS d FROM e WHERE {_STRICT} AND fc IN (3, 4) GROUP BY ALL) GROUP BY 1, 2"""))
def wire_poll_coverage(spark, folder):
    return report.poll_coverage(pairs(spark, folder).done(), "10 minutes")


@query(capture.sql("""SELECT capture_id, device, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS missed FROM (
SELECT *, sum(CASE WHEN answered THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id, device ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
SELECT *, coalesce(lead(role) OVER n = 'response' AND lead(device) OVER n = device, false) AS answered FROM f WINDOW n AS (PARTITION BY capture_id ORDER BY off)) WHERE role='request')
WHERE NOT answered GROUP BY capture_id, device, g HAVING count(*) >= 2"""))
def wire_unanswered(spark, folder):
    return report.unanswered(frames(spark, folder), at_least=2)


def _s16_sql(v: str) -> str:
    return f"(CASE WHEN {v} >= 32768 THEN {v} - 65536 ELSE {v} END)"


def _at_sql(kind: str, offset: int) -> str:
    """16-bit value at a byte offset of the sent block, from its words."""
    i = offset // 2
    if offset % 2 == 0:
        return capture.sql_sent(i)
    return f"(({capture.sql_sent(i)} & 255) * 256 + ({capture.sql_sent(i + 1)} >> 8))"


def _field_sql(f) -> str:
    if f.kind == "text20":
        value = " || ".join(f"chr({capture.sql_sent(i)} >> 8) || chr({capture.sql_sent(i)} & 255)" for i in range(10))
        value = f"CASE WHEN NOT absent THEN {value} ELSE repeat(chr(0), 20) END"
    elif f.kind == "u8":
        word = capture.sql_sent(f.offset // 2)
        value = f"({word} >> 8)" if f.offset % 2 == 0 else f"({word} & 255)"
    elif f.kind in ("u16", "s16"):
        value = _at_sql(f.block, f.offset)
        value = f"({_s16_sql(value)} + {f.bias})" if f.kind == "s16" else value
    else:
        value = f"(CAST({_at_sql(f.block, f.offset)} AS BIGINT) * 65536 + {_at_sql(f.block, f.offset + 2)})"
        if f.kind == "s32":
            value = f"(CASE WHEN {value} >= 2147483648 THEN {value} - 4294967296 ELSE {value} END)"
    kind = "VARCHAR" if f.kind == "text20" else "BIGINT" if f.kind.endswith("32") else "INTEGER"
    return f'CAST(CASE WHEN kind=\'{f.block}\' THEN {value} END AS {kind}) AS "{f.name}"'


def _decoded_sql(fields, where="true") -> str:
    return capture.sql(f"""SELECT capture_id, req_off AS pair_off, rsp_ts AS ts, device, fc, addr, CASE WHEN fc IN (3, 4) THEN "count" END AS "count",
{', '.join(_field_sql(f) for f in fields)} FROM e WHERE {_STRICT}""")


@query(_decoded_sql(STANDARD))
def wire_decoded(spark, folder):
    """Every field of every decoded block, through hexdump text and framing."""
    return wire_table(pairs(spark, folder).done())


@query(_decoded_sql(EXTENDED))
def wire_decoded_extended(spark, folder):
    return wire_table(pairs(spark, folder).done(), fields=EXTENDED)


_REG_ROWS = f"""SELECT capture_id, req_off AS pair_off, rsp_ts AS ts, device, fc, CAST(addr + i AS INTEGER) AS reg,
CASE WHEN kind='write' THEN "count" ELSE {capture.sql_sent('i')} END AS value
FROM (SELECT *, unnest(range(CASE WHEN kind='write' THEN 1 ELSE "count" END)) AS i FROM e WHERE {_STRICT})"""


@query(capture.sql(f"SELECT device, fc, reg, count(*) AS n, min(value) AS min, max(value) AS max, CAST(sum(value) AS BIGINT) AS total FROM ({_REG_ROWS}) GROUP BY 1, 2, 3"))
def wire_registers(spark, folder):
    rows = register_rows(pairs(spark, folder, exceptions=True).done())
    return rows.groupBy("device", "fc", "reg").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("total"))


@query(capture.sql(f"""SELECT device, fc, reg, n_distinct, CASE WHEN n_distinct <= 1 THEN 'constant' WHEN n_distinct <= 3 THEN 'state'
WHEN n_distinct <= 10 THEN 'slow' WHEN n_distinct >= 85 THEN 'fast' ELSE 'medium' END AS kind FROM (SELECT device, fc, reg, count(DISTINCT value) AS n_distinct FROM ({_REG_ROWS}) GROUP BY 1, 2, 3)"""))
def wire_variability(spark, folder):
    rows = register_rows(pairs(spark, folder, exceptions=True).done())
    return stats.distinct_profile(rows, ["device", "fc", "reg"], "value")


@query(capture.sql(f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(CAST(epoch_ms(ts) % 1000 AS INTEGER) AS VARCHAR), 3, '0') AS datetime, device AS device_id,
'holding:23' AS register, printf('0x%04X', value) AS value_hex, value AS value_unsigned, CAST({_s16_sql('value')} AS INTEGER) AS value_signed
FROM ({_REG_ROWS}) WHERE fc=3 AND reg=23"""))
def wire_register_log(spark, folder):
    return register_log_rows(watch_register(pairs(spark, folder).done(), 3, 23))


#: Registers that occur in the capture, so that the columns found are these.
STATE_SPECS = ["1:3:11", "sw@2:3:23", "1:4:0x15+1", "2:4:0x28", "1:6:231", "b@1:3:19"]
STATE_COLUMNS = [
    FieldColumn(1, 3, 11, 0, "w"), FieldColumn(2, 3, 23, 0, "sw"), FieldColumn(1, 4, 0x15, 1, "w"),
    FieldColumn(2, 4, 0x28, 0, "w"), FieldColumn(1, 6, 231, 0, "w"),
    *[FieldColumn(1, 3, 19, 0, "b", i, i) for i in range(16)],
]


def _held_sql(device: int, fc: int, reg: int) -> str:
    i = f"({reg} - addr)"
    inside = f"device={device} AND fc={fc} AND {_STRICT}"
    if fc == 6:
        value = f"CASE WHEN {inside} AND addr={reg} THEN \"count\" END"
    else:
        value = f"CASE WHEN {inside} AND {reg} BETWEEN addr AND addr+\"count\"-1 THEN {capture.sql_sent(i)} END"
    return f"last_value({value} IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _state_sql() -> str:
    holders = sorted({r for c in STATE_COLUMNS for r in c.registers})
    held = ", ".join(f"{_held_sql(*r)} AS h_{r[0]}_{r[1]}_{r[2]}" for r in holders)
    out = []
    for c in STATE_COLUMNS:
        names = [f"h_{d}_{f}_{r}" for d, f, r in c.registers]
        word = names[0] if c.offset % 2 == 0 else f"(({names[0]} & 255) * 256 + ({names[-1]} >> 8))"
        value = {"w": word, "sw": _s16_sql(word), "b": f"(({word} >> {c.index}) & 1) + {2 * c.lane}"}[c.mode]
        out.append(f'CAST({value} AS INTEGER) AS "{c.name}"')
    names = ", ".join(f'"{c.name}"' for c in STATE_COLUMNS)
    return capture.sql(f"""SELECT capture_id, req_off AS pair_off, rsp_ts AS ts, {names} FROM (SELECT *, row_number() OVER s AS rk, lag(row({names})) OVER s AS before FROM (
SELECT capture_id, req_off, rsp_ts, rn, {', '.join(out)} FROM (SELECT capture_id, req_off, rsp_ts, rn, {held} FROM e))
WINDOW s AS (PARTITION BY capture_id ORDER BY rn)) WHERE rk = 1 OR row({names}) IS DISTINCT FROM before""")


@query(_state_sql())
def wire_register_state(spark, folder):
    return state_table(walked(spark, folder), STATE_SPECS)[0].select("capture_id", "pair_off", "ts", *[c.name for c in STATE_COLUMNS])


_INTERVALS = """SELECT {keys}, device, fc, reg, value, ts AS from_ts, {place}, lead(ts) OVER w AS to_ts, {place_to}
FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS rk FROM ({rows}) WINDOW w AS (PARTITION BY {keys}, device, fc, reg ORDER BY {order}))
WHERE rk = 1 OR value IS DISTINCT FROM before WINDOW w AS (PARTITION BY {keys}, device, fc, reg ORDER BY {order})"""


def _intervals_sql(rows: str, order: list[str]) -> str:
    place, to = ", ".join(f"{o} AS from_{o}" for o in order), ", ".join(f"lead({o}) OVER w AS to_{o}" for o in order)
    return _INTERVALS.format(keys="capture_id", place=place, place_to=to, order=", ".join(order), rows=rows)


@query(capture.sql(f"""SELECT capture_id, device, fc, reg, count(*) AS n, count(to_ts) AS ended, CAST(sum(value) AS BIGINT) AS total, max(to_pair_off - from_pair_off) AS longest,
max(epoch_us(to_ts) - epoch_us(from_ts)) AS longest_us FROM ({_intervals_sql(_REG_ROWS, ["pair_off"])}) GROUP BY 1, 2, 3, 4"""))
def wire_state_intervals(spark, folder):
    """Log text to the state of every register, from when until when it held which value; here
    how many intervals there are and the longest of each."""
    held = state_intervals(register_updates(pairs(spark, folder, exceptions=True), blocks=True))
    us = F.timestamp_diff("MICROSECOND", F.col("from_ts"), F.col("to_ts"))
    return held.groupBy("capture_id", "device", "fc", "reg").agg(
        F.count("*").alias("n"), F.count("to_ts").alias("ended"), F.sum("value").alias("total"),
        F.max(F.col("to_pair_off") - F.col("from_pair_off")).alias("longest"), F.max(us).alias("longest_us"))


_WIDE_REGS = """SELECT 'site_' || CAST(l_suppkey % 2 AS VARCHAR) AS capture_id, CAST(1 + l_suppkey % 5 AS INTEGER) AS device, 3 AS fc, CAST(l_partkey AS INTEGER) AS reg,
CAST(l_quantity AS INTEGER) // 10 AS value, l_orderkey * 10 + l_linenumber AS seq, TIMESTAMP '2026-01-01' + to_seconds(l_orderkey) AS ts FROM lineitem"""


@query(_intervals_sql(_WIDE_REGS, ["seq", "value"]))
def register_intervals(spark, folder):
    """Some thousand registers of a few captures: more than a table could have columns."""
    li, start = table(spark, folder, "lineitem"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    updates = li.select(
        F.concat(F.lit("site_"), (F.col("l_suppkey") % 2).cast("string")).alias("capture_id"), (1 + F.col("l_suppkey") % 5).cast("int").alias("device"),
        F.lit(3).alias("fc"), F.col("l_partkey").cast("int").alias("reg"), F.floor(F.col("l_quantity").cast("int") / 10).cast("int").alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (start + F.make_dt_interval(secs=F.col("l_orderkey").cast("decimal(18,6)"))).alias("ts"))
    return state_intervals(updates, order=["seq", "value"])


_PATCHED = f"""SELECT capture_id, pair_off, any_value(device) AS device, count(*) FILTER (new <> old) AS overridden,
any_value(printf('%02X0338', device)) || string_agg(printf('%04X', coalesce(new, old)), '' ORDER BY i) AS body FROM (
SELECT capture_id, req_off AS pair_off, e.device, i, CAST(sent AS INTEGER) AS old, o.value AS new FROM (SELECT *, unnest(range(28)) AS i FROM e WHERE kind='HR') e
JOIN LATERAL (SELECT {capture.sql_sent('e.i')} AS sent) s ON true LEFT JOIN o ON o.device=e.device AND o.reg=e.i) GROUP BY 1, 2 HAVING count(*) FILTER (new <> old) > 0"""


@query(capture.sql(f"""{", o AS (SELECT CAST(1 + s_suppkey % 2 AS INTEGER) AS device, CAST(s_suppkey * 5 % 28 AS INTEGER) AS reg, CAST(max_by(s_suppkey * 37 % 65536, s_suppkey) AS INTEGER) AS value FROM supplier WHERE s_suppkey % 17 = 0 GROUP BY 1, 2) "}
SELECT capture_id, pair_off, device, CAST(overridden AS INTEGER) AS overridden, body, CAST({_crc_sql('body')} AS INTEGER) AS crc FROM ({_PATCHED})"""))
def override_responses(spark, folder):
    """Registers overridden inside the recorded responses; the CRC follows."""
    s = F.col("s_suppkey")
    edits = table(spark, folder, "supplier").where(s % 17 == 0).select(
        (1 + s % 2).cast("int").alias("device"), F.lit(3).alias("fc"), (s * 5 % 28).cast("int").alias("reg"), s.alias("edit_seq"), (s * 37 % 65536).cast("int").alias("value"))
    found = override_frames(pairs(spark, folder).done(), dims.settle_overrides(edits)).where("overridden > 0")
    size = F.length("rsp_raw")
    crc = u8("rsp_raw", size - 2) + 256 * u8("rsp_raw", size - 1)
    return found.select("capture_id", "pair_off", "device", "overridden", F.hex(F.substring("rsp_raw", F.lit(1), size - 2)).alias("body"), crc.alias("crc"))


@query(capture.sql(f"""SELECT capture_id, kind AS block, device, count(*) AS n, count(*) FILTER (absent) AS absent FROM b WHERE kind IN ('IR1', 'IR2', 'IR3') GROUP BY 1, 2, 3"""))
def wire_absent_packs(spark, folder):
    found = pairs(spark, folder).done().where(F.col("fc") == 4)
    data = F.col("rsp_raw").substr(F.lit(5), F.length("rsp_raw") - 6)
    block = F.when(F.col("addr") == 0, "IR1").when(F.col("addr") == 21, "IR2").otherwise("IR3")
    gone = F.lit(False)
    for name in ("IR1", "IR2", "IR3"):
        gone = F.when(block == name, telemetry.absent_block(data, name)).otherwise(gone)
    return found.groupBy("capture_id", block.alias("block"), "device").agg(F.count("*").alias("n"), F.count_if(gone).alias("absent"))


SERIAL = "01122334"


@query(capture.sql(f"""SELECT capture_id, count(*) AS frames, count(*) FILTER (serial LIKE '%{SERIAL}%') AS masked, count(*) AS valid FROM (
SELECT capture_id, CASE WHEN fc=4 THEN {' || '.join(f"chr({capture.sql_sent(i)} >> 8) || chr({capture.sql_sent(i)} & 255)" for i in range(10))} ELSE '' END AS serial FROM b WHERE kind IN ('HR', 'IR1', 'IR2', 'IR3')) GROUP BY 1"""))
def wire_redacted(spark, folder):
    """Serials masked inside frames; the frames stay valid."""
    reads = frames(spark, folder).done().where((F.col("role") == "response") & F.col("fc").isin(3, 4))
    hidden = redact_frames(reads, [SERIAL]).withColumn("ok", valid_crc("raw"))
    masked = ascii_text("raw", 4, 20).contains("X" * len(SERIAL))
    return hidden.groupBy("capture_id").agg(F.count("*").alias("frames"), F.count_if(masked & (F.col("fc") == 4)).alias("masked"), F.count_if("ok").alias("valid"))


_CELLS = "[" + ", ".join(capture.sql_sent(i) for i in range(16)) + "]"


@query(capture.sql(f"""SELECT capture_id, pair_off, device, list_min(cells) AS "MinCellVoltage", list_max(cells) AS "MaxCellVoltage",
CAST(list_position(cells, list_min(cells)) AS INTEGER) AS "MinCellId", CAST(list_position(cells, list_max(cells)) AS INTEGER) AS "MaxCellId"
FROM (SELECT capture_id, req_off AS pair_off, device, {_CELLS} AS cells FROM e WHERE kind='IR3')"""))
def wire_cell_extremes(spark, folder):
    wire = wire_table(pairs(spark, folder).done(), fields=[f for f in STANDARD if f.name.startswith("cell_") and f.block == "IR3"])
    cells = F.array(*[F.col(f"cell_{i}_mV") for i in range(16)])
    units = telemetry.other_protocol_units(wire.where((F.col("fc") == 4) & (F.col("addr") == 40)), cells)
    return units.select("capture_id", "pair_off", "device", "MinCellVoltage", "MaxCellVoltage", "MinCellId", "MaxCellId")


@query(capture.sql(f"""SELECT capture_id, device, pair_off, ts, before AS prev_value, online AS new_value FROM (
SELECT *, lag(online) OVER (PARTITION BY capture_id, device ORDER BY pair_off) AS before FROM (
SELECT capture_id, device, req_off AS pair_off, rsp_ts AS ts, {capture.sql_sent(11)} // 8192 AS online FROM e WHERE kind='HR')) WHERE before <> online"""))
def wire_capacity_changes(spark, folder):
    """Steps of the online-capacity register, in coarse units."""
    wire = wire_table(pairs(spark, folder), fields=[f for f in EXTENDED if f.name == "hr11_online_Ah"])
    online = F.floor(F.col("hr11_online_Ah") / 8192).cast("int")
    steps = wire.select("capture_id", "device", "pair_off", "ts", online.alias("online"))
    found = changes.changes(steps, ["capture_id", "device"], ["pair_off"], "online")
    return found.select("capture_id", "device", "pair_off", "ts", "prev_value", "new_value")


_JOINED = f"""SELECT w.capture_id, w.pair_off, w.ts, w.device, w.fc, w.addr, p.o_totalprice AS tcp_price, p.o_orderkey AS tcp_order, t.o_orderpriority AS active_tag,
CASE WHEN t.o_orderkey IS NOT NULL THEN 'manual' END AS tag_source, CAST(CASE WHEN kind='HR' THEN {_s16_sql(capture.sql_sent(23))} END AS INTEGER) AS "hr23_pack_current_cA",
CAST(CASE WHEN kind='IR2' THEN {capture.sql_sent(12)} & 255 END AS INTEGER) AS soc_pct
FROM (SELECT *, req_off AS pair_off, rsp_ts AS ts FROM e WHERE {_STRICT}) w
ASOF LEFT JOIN o p ON p.capture_id=w.capture_id AND w.ts >= p.ts ASOF LEFT JOIN (SELECT * FROM o WHERE o_orderstatus='P') t ON t.capture_id=w.capture_id AND w.ts >= t.ts"""


def _order_streams(spark, folder):
    o = table(spark, folder, "orders")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("o_orderkey") * F.lit(1.3).cast("decimal(2,1)")).cast("decimal(18,6)"))
    base = o.withColumns({"capture_id": F.concat(F.lit("bus_"), (F.col("o_custkey") % 8).cast("string")), "ts": at})
    polls = base.select("capture_id", "ts", F.col("o_totalprice").alias("tcp_price"), F.col("o_orderkey").alias("tcp_order"), F.col("o_orderkey").alias("seq"))
    tags = base.where(F.col("o_orderstatus") == "P").select(
        "capture_id", "ts", F.col("o_orderpriority").alias("tag"), F.lit("manual").alias("source"), F.col("o_orderkey").alias("seq"))
    return polls, tags


@query(capture.sql(f"""{', o AS (SELECT *, ' + "'bus_' || CAST(o_custkey % 8 AS VARCHAR) AS capture_id, TIMESTAMP '2026-01-01' + to_milliseconds(o_orderkey*1300) AS ts FROM orders) "} {_JOINED}"""))
def joined_streams(spark, folder):
    """Log text, polls and tags to one table: the flagship job."""
    found = framed(capture.log_lines(spark, folder), capture.LINE_KEYS)
    wire = wire_table(pair_run(frames_only(found)).done())
    slim = wire.select("capture_id", "pair_off", "ts", "device", "fc", "addr", "hr23_pack_current_cA", "soc_pct")
    polls, tags = _order_streams(spark, folder)
    return join_streams(slim, polls, tags, by=["capture_id"], seq={"wire": "pair_off", "polls": "seq", "tags": "seq"})
