"""Runs that lack the moment a question is about."""

import duckdb

import __spark_entry__ as entry
from causeway.operators import history as H


def test_runs_without_a_purchase_are_never_after_it(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    # one run loses all its events that may write `purchase`
    con.execute(f"""COPY (SELECT * FROM '/root/testdata/sf0.001/events.parquet' WHERE user_id <> (SELECT min(user_id) FROM '/root/testdata/sf0.001/events.parquet')
      OR (event_type <> 'purchase' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) < 90)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(map(str, con.execute(entry.oracle_sql()["g6_temporal_steps"]).fetchall()))
    got = entry.queries()["g6_temporal_steps"](spark, str(tmp_path)).select("run_id", "step", "at").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_unknown_moments(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "run_id string, step long")
    moments = spark.createDataFrame([("a", 1)], "run_id string, lo long")
    assert sorted(map(tuple, H.temporal_steps(rows, "after", moments).collect())) == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in H.temporal_steps(rows, "after", moments, unknown=False).collect()] == [("a", 2)]
