import duckdb
import pytest

from tracewarden.plans import contract

SF = "/root/testdata/sf0.001"
# Alerts of the derived log at this scale, from an independent simulator.
COUNTS = {"BRUTE_FORCE": 44, "BRUTE_FORCE_SUCCESS": 2, "COMPROMISED_DEVICE": 13, "DANGER_CHAIN": 17, "DATA_EXFILTRATION": 11, "DEVICE_HOPPING": 62, "DORMANT_ACCOUNT": 10, "IMPOSSIBLE_TRAVEL": 492, "LATERAL_MOVEMENT": 15, "LONG_SESSION": 22, "MULTI_COUNTRY_HOPPING": 53, "OUT_OF_HOURS": 35, "RAPID_SESSION": 72, "RESOURCE_SCAN": 75}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in contract.QUERIES if not n.startswith("report_t")])
def test_same_rows_as_sql(spark, db, name):
    got = contract.QUERIES[name](spark, SF)
    want = db.execute(contract.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_counts_by_type(spark):
    assert {r["anomaly_type"]: r["alerts"] for r in contract.QUERIES["report_by_type"](spark, SF).collect()} == COUNTS


def test_every_query_has_sql():
    assert contract.QUERIES.keys() == contract.ORACLES.keys()


def test_streaming_finds_what_the_batch_finds(spark, tmp_path):
    """Also when the earliest events come last: alerts that they make untrue are taken back."""
    from tracewarden.operators.rules import detect
    from tracewarden.schema import EVENTS
    from tracewarden.sources.events_table import derived_log
    from tracewarden.streaming.detection import current_alerts, watch

    events = derived_log(spark, SF).select(*EVENTS.names).filter("seq < 300")
    for k in (2, 0, 1):
        events.filter(f"seq >= {100 * k} and seq < {100 * k + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch(stream, str(tmp_path / "events"), str(tmp_path / "alerts"), str(tmp_path / "state"), buckets=4).awaitTermination()
    found = sorted(map(tuple, current_alerts(spark, str(tmp_path / "alerts")).collect()))
    assert found == sorted(map(tuple, detect(events, device_order="time").collect()))
    changes = spark.read.parquet(str(tmp_path / "alerts" / "user_id")).groupBy("change").count().collect()
    assert {r["change"] for r in changes} == {1, -1}
