"""Failure streaks on a table made for them."""

import datetime

import duckdb

from marlstone.plans import registry


def test_a_failure_streak_is_the_last_three_events(spark, tmp_path):
    """Two errors after a good event, or two events in all, are no streak; older events do not matter; ties go by the event's id."""
    kinds = {1: "view error error", 2: "error error error", 3: "error error", 4: "view error error error", 5: "error error error view", 6: "error error error error"}
    start = datetime.datetime(2024, 1, 1)
    rows = [(10 * u + k, u, kind, start + datetime.timedelta(minutes=k // 2)) for u, all_ in kinds.items() for k, kind in enumerate(all_.split())]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["window_failure_streak"](spark, str(tmp_path)).collect()
    assert sorted(r["user_id"] for r in got) == [2, 4, 6]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(r[0] for r in con.sql(registry.oracle_sql()["window_failure_streak"]).fetchall()) == [2, 4, 6]
