"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
# A cross-section; the full set runs with the driver.
CHECKED = [
    "asof_poll", "asof_global", "last_known", "min_gap", "coincident_changes", "latency_by_type", "whatif_override",
    "redact_documents", "hexdump_lines", "wire_frames", "wire_register_state", "joined_streams",
]


@pytest.fixture(scope="module")
def con():
    base = duckdb.connect()
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return base


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, con, name):
    df = driver.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_pending_pairs_equal_a_plain_queue(spark):
    from wiretide.plans import table_capture

    frames = table_capture.frames(spark, FOLDER).orderBy("capture_id", "off").collect()
    queues, want = {}, []
    for f in frames:
        queue = queues.setdefault(f.capture_id, [])
        if f.fc not in (3, 4):
            continue
        if f.role == "request":
            count = int.from_bytes(bytes(f.raw)[4:6], "big")
            if len(queue) == 32:
                queue.pop(0)
            queue.append((f.off, f.device, f.fc, count))
            continue
        hit = next((q for q in queue if q[1:3] == (f.device, f.fc) and f.len == 2 * q[3] + (6 if f.fc == 4 else 5)), None)
        if hit:
            queue.remove(hit)
            want.append((f.capture_id, hit[0], f.off))
    got = driver.queries()["wire_pairs_pending"](spark, FOLDER).collect()
    assert sorted((r.capture_id, r.req_off, r.rsp_off) for r in got) == sorted(want)
