"""Fields that no list names."""

import json

from wiretide.sources.ndjson import POLL_FIELDS, read_polls


def test_unknown_poll_fields_become_columns(spark, tmp_path):
    polls = [{"ts": "2026-05-01T07:00:00", "fields": {"soc": 50.5, "inverter_mode": "idle"}}, {"ts": "2026-05-01T07:00:01", "fields": {"new_limit": 7}}]
    (tmp_path / "polls.ndjson").write_text("".join(json.dumps(p) + "\n" for p in polls))
    found = read_polls(spark, str(tmp_path))
    assert found.columns == ["ts", *(f"tcp_{f}" for f in POLL_FIELDS), "tcp_inverter_mode", "tcp_new_limit"]
    rows = found.orderBy("ts").collect()
    assert [(r.tcp_soc, r.tcp_inverter_mode, r.tcp_new_limit) for r in rows] == [(50.5, "idle", None), (None, None, "7")]
    assert read_polls(spark, str(tmp_path), {"soc": "double"}).columns == ["ts", "tcp_soc"]
