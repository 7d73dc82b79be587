import datetime

import duckdb
from pyspark.sql import functions as F

from tracewarden.functions.timeparse import literal_epoch, parse_time
from tracewarden.plans import contract


def test_time_literals_of_a_log_that_runs_past_2100(spark, tmp_path):
    """Twenty events of the year 2401: the query reads their times, what people type still ends with 2100."""
    rows = [(5_999_000 + k, datetime.datetime(2024, 1, 1), k, "click", 1.0, "") for k in range(20)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(contract.ORACLES["time_literals"]).fetchall()
    got = contract.QUERIES["time_literals"](spark, str(tmp_path)).select("seq", "text", "epoch").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    typed = ["2100-12-31 23:59:59", "2101-01-01"]
    read = spark.createDataFrame([(t,) for t in typed], "t string").select(literal_epoch(F.col("t"), 0)).collect()
    assert [r[0] for r in read] == [parse_time(t) for t in typed] == [4133980799, None]
