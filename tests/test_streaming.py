from tracewarden.operators.rules import detect
from tracewarden.schema import EVENTS
from tracewarden.streaming.detection import current_alerts, watch


def test_late_login_moves_an_alert_of_a_logout(spark, tmp_path):
    """A late login opens the session that a logout ends: its alert keeps event, rule and number, and has another place."""
    login, logout = ("u", "d", "a", "r", "LOGIN", "VN", 900_000, 0), ("u", "d", "a", "r", "LOGOUT", "VN", 1_000_000, 1)
    for row in (logout, login):
        spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch(stream, str(tmp_path / "events"), str(tmp_path / "alerts"), str(tmp_path / "state"), buckets=2).awaitTermination()
    found = sorted(map(tuple, current_alerts(spark, str(tmp_path / "alerts")).collect()))
    assert found == sorted(map(tuple, detect(spark.createDataFrame([login, logout], EVENTS), device_order="time").collect()))
    assert [(r[4], r[6], r[7]) for r in found if r[0] == 1] == [("LONG_SESSION", 7, 1), ("LONG_SESSION", 10, 2)]
