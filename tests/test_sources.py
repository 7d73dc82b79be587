import pytest
from pyspark.sql import functions as F

from tracewarden.functions.timeparse import parse_time, time_literal, time_range
from tracewarden.operators import journeys
from tracewarden.operators.rules import detect
from tracewarden.plans import report
from tracewarden.schema import HEADER
from tracewarden.sources import snapshot
from tracewarden.sources.generator import generate, write_log
from tracewarden.sources.log_text import read_log

ROW = "u001,d001,appA,resX,LOGIN,VN,1716000000"


def load(spark, tmp_path, text):
    path = tmp_path / "log.csv"
    path.write_bytes(text.encode())
    events, rejects = read_log(spark, str(path))
    return [tuple(r) for r in events.orderBy("seq").collect()], sorted((r["reason"], r["line"]) for r in rejects.collect())


def test_accepts_and_rejects(spark, tmp_path):
    lines = [HEADER, ROW, ROW, "u001,d001,appA,resX,FAILED_LOGIN,VN,1716000010", "u002,d009,appB,resY,ACCESS,MARS,1716000020", "u003,d003,appC,resZ,DOWNLOAD,US,not_a_timestamp"]
    rows, bad = load(spark, tmp_path, "\n".join(lines))
    assert [(r[0], r[4], r[6], r[7]) for r in rows] == [("u001", "LOGIN", 1716000000, 0), ("u001", "FAILED_LOGIN", 1716000010, 1)]
    assert [b[0] for b in bad] == ["duplicate", "location", "timestamp"]


@pytest.mark.parametrize("last", ["-5", "+5", " 5", "5 ", "9223372036854775808", ""])
def test_bad_times(spark, tmp_path, last):
    assert load(spark, tmp_path, f"u,d,a,r,LOGIN,US,{last}\n")[0] == []


def test_odd_lines(spark, tmp_path):
    good = ["u,d,a,r,LOGIN,US,007", "u,d,a,r,LOGIN,US,9223372036854775807", "u,d,a,r,LOGIN,US,8\r", "u,d,a,r,LOGIN,US,8"]
    bad = ["u,d,a,r,login,US,1", "u,d,a,r, LOGIN,US,1", "u,d,a,r,LOGIN,US", "u,d,a,r,LOGIN,US,1,2", ",d,a,r,LOGIN,US,1", '"u,v",d,a,r,LOGIN,US,1', HEADER, "\r"]
    rows, rejects = load(spark, tmp_path, "\n\n" + HEADER + "\r\n" + "\n".join(good + bad))
    assert [r[6] for r in rows] == [7, 9223372036854775807, 8, 8]
    assert len(rejects) == len(bad)


def test_empty_and_missing(spark, tmp_path):
    assert load(spark, tmp_path, "") == ([], [])
    with pytest.raises(Exception):
        read_log(spark, str(tmp_path / "none.csv"))[0].count()


def test_file_order_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("\n".join(f"u{k},d,a,r,LOGIN,US,{1000 + k % 7}" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [(r["user_id"], r["seq"]) for r in read_log(spark, str(path))[0].collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got, key=lambda x: x[1]) == [(f"u{k}", k) for k in range(5000)]


def test_snapshot_round_trip(spark, tmp_path):
    source = tmp_path / "log.csv"
    source.write_text(f"{HEADER}\n{ROW}\n")
    place = snapshot.snapshot_path(str(source))
    assert place.endswith("log_snapshot") and not snapshot.is_fresh(spark, place, str(source))
    first = [tuple(r) for r in snapshot.open_log(spark, str(source)).collect()]
    assert snapshot.is_fresh(spark, place, str(source))
    assert [tuple(r) for r in snapshot.load_snapshot(spark, place).collect()] == first
    source.write_text(f"{HEADER}\n{ROW}\n{ROW.replace('LOGIN', 'LOGOUT')}\n")
    assert not snapshot.is_fresh(spark, place, str(source))
    assert snapshot.open_log(spark, str(source)).count() == 2
    (tmp_path / "log_snapshot" / "manifest.json").write_text('{"magic": "tracewarden-log", "version": 1, "rows": 9, "checksum": 0}')
    with pytest.raises(ValueError):
        snapshot.load_snapshot(spark, place)


def test_times():
    assert parse_time("2024-02-31") == parse_time("2024-03-02")
    assert parse_time("1969-01-01") is None and parse_time("x") is None
    assert parse_time("1970-01-02 01:02:03 and more") == 86400 + 3723
    assert time_literal("", 7) == 7 and time_literal("-5", 0) == -5
    assert time_range("20", "10") == (10, 20)
    with pytest.raises(ValueError):
        time_range("soon")


def test_generated_log_has_its_attacks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tracewarden.sources.generator.PERIOD", 1000)
    events = generate(spark, 3000)
    assert events.count() == 3000 + 3 * 15
    assert [tuple(r) for r in events.orderBy("seq").limit(50).collect()] == [tuple(r) for r in generate(spark, 3000).orderBy("seq").limit(50).collect()]
    kinds = {r["anomaly_type"] for r in report.by_type(detect(events)).collect()}
    assert {"COMPROMISED_DEVICE", "LATERAL_MOVEMENT"} <= kinds
    write_log(events, str(tmp_path / "out"))
    again, rejects = read_log(spark, str(tmp_path / "out"))
    assert again.count() == 3045 and rejects.count() == 0


def test_status_pages_and_text(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("\n".join(f"u,d,a,r,LOGIN,US,{k}" for k in range(120)))
    events = read_log(spark, str(path))[0]
    assert [journeys.status(events, "user_id", u, 0, 500) for u in ("u", "v")] == ["found", "unknown"]
    assert journeys.status(events, "user_id", "u", 500, 600) == "empty"
    assert journeys.page(journeys.user_journey(events, "u"), 2).count() == 20
    assert "TOTAL" in report.render(detect(events), events)
    found = detect(events)
    report.write_csv(found, events, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["timestamp", "user_id", "device_id", "anomaly_type", "severity"]
    report.write_csv(found, events, str(tmp_path / "one.csv"), single_file=True)
    lines = (tmp_path / "one.csv").read_text().split("\n")
    assert lines[0] == report.CSV_HEADER and len(lines) == found.count() + 2 and lines[-1] == ""


def test_csv_writes_values_as_they_are(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('a "b",d\\e,a,r,ACCESS,US,61200\n')
    events = read_log(spark, str(path))[0]
    report.write_csv(detect(events), events, str(tmp_path / "out.csv"), single_file=True)
    assert (tmp_path / "out.csv").read_text() == report.CSV_HEADER + '\n1970-01-01 17:00:00,a "b",d\\e,OUT_OF_HOURS,LOW\n'


def test_snapshots_are_pruned_by_time(spark, tmp_path):
    """A range reaches the files as a filter, and files hold ranges of time that don't overlap."""
    source = tmp_path / "log.csv"
    source.write_text("\n".join(f"u{k},d,a,r,LOGIN,US,{1000 + k * 7 % 5000}" for k in range(5000)))
    place = snapshot.snapshot_path(str(source))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        snapshot.write_snapshot(read_log(spark, str(source))[0], place, str(source))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    rows = journeys.in_range(snapshot.load_snapshot(spark, place), 2000, 2100)
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,2000), LessThanOrEqual(timestamp,2100)]" in rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert rows.count() == 101
    ranges = sorted((r["lo"], r["hi"]) for r in snapshot.load_snapshot(spark, place).groupBy(F.input_file_name()).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).collect())
    assert len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_a_failed_snapshot_leaves_the_old_one(spark, tmp_path, monkeypatch):
    source = tmp_path / "log.csv"
    source.write_text(f"{HEADER}\n{ROW}\n")
    first = [tuple(r) for r in snapshot.open_log(spark, str(source)).collect()]
    monkeypatch.setattr(snapshot, "checksum", lambda events: 1 / 0)
    source.write_text(f"{HEADER}\n{ROW}\n{ROW.replace('LOGIN', 'LOGOUT')}\n")
    with pytest.raises(ZeroDivisionError):
        snapshot.open_log(spark, str(source))
    monkeypatch.undo()
    assert [tuple(r) for r in snapshot.load_snapshot(spark, snapshot.snapshot_path(str(source))).collect()] == first


def test_decode_and_shared_places(spark):
    rows = [("u1", "d", "a", "r9", "LOGIN", "US", 1, 0), ("r2", "d", "a", "r9", "LOGIN", "US", 2, 1), ("u1", "d", "a", "r1", "LOGIN", "US", 3, 2), ("u1", "d", "a", "r2", "LOGIN", "US", 4, 3)]
    events = spark.createDataFrame(rows, "user_id string, device_id string, app_id string, resource_id string, event_type string, location string, timestamp long, seq long")
    ids = {r["value"]: r["id"] for r in journeys.dictionary(events).collect()}
    assert ids == {"u1": 0, "d": 1, "a": 2, "r9": 3, "r2": 4, "r1": 5}
    # r1 comes before r2 among resources, but r2 was seen first, as a user
    assert [r["resource_id"] for r in journeys.top_resources(events).orderBy("rank").collect()] == ["r9", "r2", "r1"]
    # chains of two: ids 3 and 5 (r9, r1) are in one, where the later first event leads
    assert [r["resource_id"] for r in journeys.top_resources(events, buckets=2).orderBy("rank").collect()] == ["r9", "r2", "r1"]
    coded = spark.createDataFrame([("4",), ("99",)], "id_text string")
    assert sorted(r[0] for r in journeys.decode(coded, journeys.dictionary(events), "id_text").collect()) == ["", "r2"]


def test_other_thresholds(spark):
    from tests.test_rules import event
    from tracewarden.schema import Thresholds

    events = spark.createDataFrame([tuple(event(k, 1_700_000_000 + 10 * k, "FAILED_LOGIN").values()) for k in range(9)], "user_id string, device_id string, app_id string, resource_id string, event_type string, location string, timestamp long, seq long")
    assert [r["seq"] for r in detect(events, Thresholds(brute_force=(3, 20)), only=("BRUTE_FORCE",)).orderBy("seq").collect()] == [2, 5, 8]
    assert detect(events, Thresholds(brute_force=(3, 19)), only=("BRUTE_FORCE",)).count() == 0
