"""Queries with an oracle on tables made for them, with values that the fixtures lack."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from oracle import rows

from marlstone.plans import registry


def same(spark, folder, name, **tables):
    for table, held in tables.items():
        pq.write_table(held, f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = registry.queries()[name](spark, str(folder))
    theirs = con.sql(registry.oracle_sql()[name])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(theirs.columns, theirs.fetchall())
    return got


def test_vector_literal_rounds_exact_values(spark, tmp_path):
    """Ties go to even, large values keep all digits, signs of zeros and of no numbers stay, missing values are left out."""
    vectors = [[-0.0703125, 0.0078125, 0.0234375], [3.4e38, -3.4e38, 1.2345679e20, 1e17, 33554434.0], [float("nan"), -float("nan"), float("inf"), -float("inf")], [-0.0, -1e-9, 1e-45], [1.5, None, 2.0], [None], [], None]
    table = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())})
    got = {vec_id: v for v, vec_id in same(spark, tmp_path, "vector_literal", embeddings=table)}
    assert got[0] == "[-0.070312,0.007812,0.023438]" and got[4] == "[1.500000,2.000000]" and got[5] is None and got[6] == "[]"


def test_alert_suppression_rounds_times_and_keeps_odd_rows(spark, tmp_path):
    """Seconds are rounded, halves to even; missing times and ids come last; without a kind or an origin the first alert has a row."""
    start, second, hour = datetime.datetime(2024, 1, 1), datetime.timedelta(seconds=1), datetime.timedelta(hours=1)
    log = [(0, "x", 0.5 * second), (0, "x", 6 * hour + 0.499 * second), (1, "x", 0.4 * second), (1, "x", 6 * hour - 0.4 * second), (2, "x", 0.6 * second), (2, "x", 6 * hour)]
    log += [(None, "x", k * 5 * hour) for k in range(4)] + [(3, None, k * 5 * hour) for k in range(4)] + [(None, None, k * 5 * hour) for k in range(4)]
    log += [(4, "x", None if k == 2 else k * 5 * hour) for k in range(5)] + [(5, "x", None)] * 3 + [(6, "x", hour)] * 3
    ids = [None if k == len(log) - 3 else k for k in range(len(log))]
    table = pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array([None if x is None else start + x for _, _, x in log], pa.timestamp("us")), "user_id": pa.array([u for u, _, _ in log], pa.int64()),
        "event_type": pa.array([k for _, k, _ in log], pa.string()), "value": pa.nulls(len(log), pa.float64()), "props": pa.nulls(len(log), pa.string()),
    })
    got = {event_id: action for action, event_id in same(spark, tmp_path, "alert_suppression", events=table)}
    assert [got[k] for k in range(6)] == ["send", "send", "send", "send", "send", "suppress"] and len(got) == len(log) - 9 and got[None] == "suppress"
