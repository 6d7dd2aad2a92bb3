"""Gaps of instants finer than milliseconds, and of odd ones, against the query's SQL."""

import duckdb
import pytest

from palimpsest.plans import catalogue

AT = "TIMESTAMP '2024-01-01 00:00:00'"

TABLES = {
    # 58.9992 s apart, 58.999 s with both rounded down and 59 s with both rounded; 47 minutes and 59.9998 s, 48 minutes with both rounded down
    "finer_than_milliseconds": f"SELECT * FROM (VALUES (1, {AT} + to_microseconds(400), 7), (2, {AT} + to_microseconds(58999600), 7), (3, {AT} + to_microseconds(600), 8), (4, {AT} + to_microseconds(2880000400), 8)) t(event_id, ts, user_id)",
    # two instants of one rounded millisecond are in the order of their ids
    "order_within_a_millisecond": f"SELECT * FROM (VALUES (2, {AT} + to_microseconds(600), 7), (1, {AT} + to_microseconds(1400), 7), (3, {AT} - to_seconds(5), 7)) t(event_id, ts, user_id)",
    # both sides of 1970, where 0 means that no instant is known
    "around_1970": "SELECT i AS event_id, make_timestamp((i * 100 - 3000)::BIGINT) AS ts, i AS user_id FROM range(60) r(i) UNION ALL SELECT i + 100, make_timestamp((i * 100 - 63000000)::BIGINT), i FROM range(60) r(i)",
    "no_instants_ids_users": f"SELECT * FROM (VALUES (1, {AT}, 7), (2, NULL, 7), (3, NULL, 7), (4, NULL, 8), (5, TIMESTAMP '1970-01-01', 9), (6, NULL, 9), (NULL, {AT}, NULL), (7, {AT}, NULL), (8, {AT} - to_minutes(3), NULL), (NULL, NULL, NULL)) t(event_id, ts, user_id)",
    "infinite_instants": f"SELECT * FROM (VALUES (1, {AT}, 7), (2, TIMESTAMP 'infinity', 7), (3, TIMESTAMP '-infinity', 7), (4, {AT} + to_hours(3), 7)) t(event_id, ts, user_id)",
}


@pytest.mark.parametrize("name", TABLES)
def test_gaps_against_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id FROM ({TABLES[name]})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    right = con.execute(catalogue.ORACLE_SQL["time_gap_labels"])
    want = [dict(zip([c[0] for c in right.description], r)) for r in right.fetchall()]
    found = [r.asDict() for r in catalogue.QUERIES["time_gap_labels"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
