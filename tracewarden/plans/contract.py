"""Named queries over the derived access log, and the SQL that must give the same rows.

The SQL is written apart from the DataFrame code: recursion instead of folds, self-joins
and lists instead of collected sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.functions.timeparse import epoch_text, local_hour
from tracewarden.operators import journeys
from tracewarden.operators.rules import ON_DEVICES, RULES, detect, rule
from tracewarden.plans import ingest_contract, report
from tracewarden.schema import SEVERITY
from tracewarden.sources.events_table import DERIVED, derived_log
from tracewarden.sources.scratch import durable

START, END = 1_704_042_000, 1_705_500_000
USER, RESOURCE = "U00003", "R00042"


def wide(found: DataFrame) -> DataFrame:
    return found.withColumn("rule_ord", F.col("rule_ord").cast("long")).withColumn("fire_no", F.col("fire_no").cast("long"))


def all_alerts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = derived_log(spark, sf_dir)
    return durable(detect(events), "alerts"), events


def _rule(name: str, device_order: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wide(rule(name)(derived_log(spark, sf_dir), device_order=device_order or "reference"))

    return run


def _ordered_journey(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, "seq", epoch_text(F.col("timestamp")).alias("time_utc"))


def shared_names(events: DataFrame) -> DataFrame:
    """The log with resources named like users."""
    return events.withColumn("resource_id", F.concat(F.lit("U"), F.substring("resource_id", 2, 100)))


def _emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewarden.operators.ordering import with_position
    from tracewarden.operators.patterns import dictionary_places

    found, events = all_alerts(spark, sf_dir)
    ranked = found.join(dictionary_places(events, "user_id", "user_rank"), "user_id")
    out = with_position(ranked, "user_rank", "timestamp", "seq", "rule_ord", "fire_no", name="place")
    return out.select("place", epoch_text(F.col("timestamp")).alias("timestamp"), "user_id", "device_id", "anomaly_type", "severity")


def _duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived_log(spark, sf_dir)
    again = events.filter(F.col("seq") % 7 == 0).withColumn("seq", F.col("seq") + 10_000_000)
    return journeys.dedup_rows(events.unionByName(again))


QUERIES = {
    "top10_resources": lambda s, d: journeys.top_resources(derived_log(s, d)),
    "top10_resources_range": lambda s, d: journeys.top_resources(derived_log(s, d), END, START),
    "top10_shared_names": lambda s, d: journeys.top_resources(shared_names(derived_log(s, d)), START, END),
    "top10_modulo_ties": lambda s, d: journeys.top_resources(derived_log(s, d), START, END, buckets=7),
    "user_journey": lambda s, d: _ordered_journey(journeys.user_journey(derived_log(s, d), USER, START, END), "timestamp", "event_type", "device_id", "app_id", "resource_id", "location"),
    "resource_history": lambda s, d: _ordered_journey(journeys.resource_history(derived_log(s, d), RESOURCE), "timestamp", "event_type", "user_id", "device_id", "app_id", "location"),
    "device_history": lambda s, d: journeys.device_history(derived_log(s, d), "D00005", START, END),
    "app_history": lambda s, d: journeys.app_history(derived_log(s, d), "APP0007", END, START),
    "log_without_user": lambda s, d: journeys.without(derived_log(s, d), "user_id", USER),
    "time_range_filter": lambda s, d: journeys.in_range(derived_log(s, d), START, END),
    "dedup_rows": _duplicated,
    "dictionary_ranks": lambda s, d: journeys.dictionary(derived_log(s, d)),
    "default_keys": lambda s, d: journeys.default_keys(derived_log(s, d)),
    "local_hour": lambda s, d: derived_log(s, d).groupBy(local_hour(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("events")),
    "epoch_format": lambda s, d: derived_log(s, d).select("seq", epoch_text(F.col("timestamp")).alias("time_utc")),
    "row_count": lambda s, d: derived_log(s, d).agg(F.count("*").alias("events")),
    **{f"rule_{name.lower()}": _rule(name) for name in RULES},
    **{f"rule_{name.lower()}_time_order": _rule(name, "time") for name in ON_DEVICES},
    "anomalies_all": lambda s, d: wide(all_alerts(s, d)[0]),
    "report_by_type": lambda s, d: report.by_type(all_alerts(s, d)[0]),
    "report_by_severity": lambda s, d: report.by_severity(all_alerts(s, d)[0]),
    "report_top5_users": lambda s, d: report.riskiest_users(*all_alerts(s, d)),
    "report_total": lambda s, d: all_alerts(s, d)[0].agg(F.count("*").alias("alerts")),
    "report_emission_order": _emission,
    **ingest_contract.QUERIES,
}

EV = "ev AS (" + DERIVED.format(events="events") + ")"
HOUR = "((timestamp + 25200) % 86400) // 3600"


def _shape(name: str, source: str, order: str = "0", fire: str = "1") -> str:
    return f"SELECT seq, timestamp, user_id, device_id, '{name}' AS anomaly_type, '{SEVERITY[name]}' AS severity, CAST({order} AS BIGINT) AS rule_ord, CAST({fire} AS BIGINT) AS fire_no FROM {source}"


def _tail(where: str, key: str, k: int, seconds: int, distinct: str = "", least: int = 0, order: str = "timestamp, seq", source: str = "ev") -> str:
    """CTEs q (qualifying rows, numbered) and c (candidates)."""
    many = f" AND len(list_distinct(a.vals)) >= {least or k}" if distinct else ""
    vals = f", list({distinct}) OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS vals" if distinct else ""
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i{vals} FROM {source} WHERE {where}),
c AS (SELECT a.* FROM q a JOIN q b ON a.{key} = b.{key} AND b.i = a.i - {k - 1} WHERE a.timestamp - b.timestamp <= {seconds}{many})"""


def _greedy(name: str, order_no: int, key: str, k: int, more: str = "", **tail) -> str:
    return f"""WITH RECURSIVE {EV}, {more}{_tail(key=key, k=k, **tail)},
nxt AS (SELECT {key}, i, min(i) OVER (PARTITION BY {key} ORDER BY i RANGE BETWEEN {k} FOLLOWING AND UNBOUNDED FOLLOWING) AS ni FROM c),
acc AS (SELECT {key}, min(i) AS i FROM c GROUP BY {key} UNION ALL SELECT n.{key}, n.ni FROM acc JOIN nxt n ON acc.{key} = n.{key} AND acc.i = n.i WHERE n.ni IS NOT NULL)
{_shape(name, f"c SEMI JOIN acc ON c.{key} = acc.{key} AND c.i = acc.i", str(order_no))}"""


def _first(name: str, order_no: int, key: str, more: str = "", **tail) -> str:
    return f"WITH {EV}, {more}{_tail(key=key, **tail)} {_shape(name, f'(SELECT * FROM c QUALIFY i = min(i) OVER (PARTITION BY {key}))', str(order_no))}"


BY = "PARTITION BY user_id ORDER BY timestamp, seq"
RANKED = "rk AS (SELECT e.*, f.r AS ur FROM ev e JOIN (SELECT user_id, min(seq) AS r FROM ev GROUP BY user_id) f ON e.user_id = f.user_id), "
MOVED = f"mv AS (SELECT *, lag(location) OVER ({BY}) AS was FROM ev), "
SESSION = f"""st AS (
  SELECT *, lag(timestamp) OVER ({BY}) AS prev,
         max(timestamp) FILTER (WHERE event_type = 'LOGIN') OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS login,
         last_value(CASE WHEN event_type IN ('LOGIN', 'LOGOUT') THEN event_type END IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge,
         count(*) FILTER (WHERE event_type = 'LOGIN') OVER ({BY}) AS seg
  FROM ev
), ss AS (SELECT *, coalesce(edge = 'LOGIN' AND prev - login <= 86400, false) AS is_open, timestamp - coalesce(login, 0) > 86400 AS is_over FROM st)"""

RULE_SQL = {
    "BRUTE_FORCE": _greedy("BRUTE_FORCE", 1, "user_id", 5, where="event_type = 'FAILED_LOGIN'", seconds=300),
    "DEVICE_HOPPING": _greedy("DEVICE_HOPPING", 2, "user_id", 3, where="event_type = 'LOGIN'", seconds=600, distinct="device_id"),
    "RESOURCE_SCAN": _greedy("RESOURCE_SCAN", 3, "device_id", 10, RANKED, where="true", seconds=300, distinct="resource_id", order="ur, timestamp, seq", source="rk"),
    "OUT_OF_HOURS": f"WITH {EV} " + _shape("OUT_OF_HOURS", f"(SELECT * FROM ev WHERE {HOUR} < 6 OR {HOUR} >= 22 QUALIFY row_number() OVER ({BY}) = 1)", "4"),
    "IMPOSSIBLE_TRAVEL": f"WITH {EV} " + _shape("IMPOSSIBLE_TRAVEL", f"(SELECT *, lag(location) OVER ({BY}) AS was, lag(timestamp) OVER ({BY}) AS prev FROM ev) WHERE was <> 'US' AND location <> 'US' AND was <> location AND timestamp - prev < 7200", "5"),
    "MULTI_COUNTRY_HOPPING": _greedy("MULTI_COUNTRY_HOPPING", 6, "user_id", 10, MOVED, where="location <> 'US' AND (was IS NULL OR was <> location)", seconds=172_800, distinct="location", least=3, source="mv"),
    "LONG_SESSION": f"WITH {EV}, {SESSION}, f AS (SELECT *, CASE WHEN event_type = 'LOGIN' THEN 0 ELSE 7 END AS o, 1 AS n FROM ss WHERE is_open AND is_over UNION ALL SELECT *, 10, CASE WHEN is_open THEN 2 ELSE 1 END FROM ss WHERE is_over AND event_type = 'LOGOUT') " + _shape("LONG_SESSION", "f", "o", "n"),
    "DANGER_CHAIN": f"WITH {EV}, {SESSION} " + _shape("DANGER_CHAIN", "(SELECT *, count(*) OVER (PARTITION BY user_id, seg ORDER BY timestamp, seq) AS nth FROM ss WHERE is_open AND event_type IN ('ADMIN_ACTION', 'DOWNLOAD')) WHERE nth % 3 = 0", "8"),
    "RAPID_SESSION": _greedy("RAPID_SESSION", 9, "user_id", 3, where="event_type = 'LOGIN'", seconds=600),
    "BRUTE_FORCE_SUCCESS": f"WITH {EV}, g AS (SELECT *, count(*) FILTER (WHERE event_type <> 'FAILED_LOGIN') OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM ev), h AS (SELECT *, count(*) OVER (PARTITION BY user_id, grp ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fails FROM g) " + _shape("BRUTE_FORCE_SUCCESS", "h WHERE event_type = 'LOGIN' AND fails >= 5", "11"),
    "DORMANT_ACCOUNT": f"WITH {EV}, d AS (SELECT *, timestamp - lag(timestamp) OVER ({BY}) > 864000 AS woke FROM ev), e AS (SELECT *, count(*) FILTER (WHERE woke) OVER ({BY}) AS seg FROM d), s AS (SELECT *, count(*) OVER (PARTITION BY user_id, seg ORDER BY timestamp, seq) AS nth, min(timestamp) OVER (PARTITION BY user_id, seg) AS wake FROM e WHERE seg > 0) " + _shape("DORMANT_ACCOUNT", "s WHERE nth = 20 AND timestamp - wake <= 600", "12"),
    "DATA_EXFILTRATION": _first("DATA_EXFILTRATION", 13, "user_id", where=f"event_type = 'DOWNLOAD' AND {HOUR} < 6", k=5, seconds=600, distinct="resource_id"),
    "COMPROMISED_DEVICE": _first("COMPROMISED_DEVICE", 14, "device_id", RANKED, where="event_type = 'LOGIN'", k=3, seconds=300, distinct="user_id", order="ur, timestamp, seq", source="rk"),
    "LATERAL_MOVEMENT": _first("LATERAL_MOVEMENT", 15, "user_id", where="true", k=4, seconds=120, distinct="app_id"),
}
TIME_ORDER_SQL = {
    "RESOURCE_SCAN": _greedy("RESOURCE_SCAN", 3, "device_id", 10, where="true", seconds=300, distinct="resource_id"),
    "COMPROMISED_DEVICE": _first("COMPROMISED_DEVICE", 14, "device_id", where="event_type = 'LOGIN'", k=3, seconds=300, distinct="user_id"),
}
ALL = "(" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in RULE_SQL.values()) + ")"
FIRST = "SELECT user_id, min(seq) AS r FROM ev GROUP BY user_id"
UTC = "strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S')"


# the log with resources named like users, most of which appear as users first
SHARED = "ev AS (SELECT * REPLACE (concat('U', substr(resource_id, 2)) AS resource_id) FROM (" + DERIVED.format(events="events") + "))"
PLACES = """SELECT value, min(pos) AS r FROM (
  SELECT user_id AS value, seq * 4 AS pos FROM ev UNION ALL SELECT device_id, seq * 4 + 1 FROM ev UNION ALL SELECT app_id, seq * 4 + 2 FROM ev UNION ALL SELECT resource_id, seq * 4 + 3 FROM ev
) GROUP BY value"""


def _top(where: str, log: str = EV, order: str = "r") -> str:
    return f"WITH {log}, n AS (SELECT resource_id, count(*) AS accesses, min(seq) AS hit FROM ev WHERE {where} GROUP BY resource_id), f AS (SELECT *, row_number() OVER (ORDER BY r) - 1 AS id FROM ({PLACES})) SELECT row_number() OVER (ORDER BY accesses DESC, {order}) AS rank, n.resource_id, accesses FROM n JOIN f ON n.resource_id = f.value QUALIFY rank <= 10"


ORACLES = {
    "top10_resources": _top("timestamp BETWEEN 0 AND 2000000000"),
    "top10_resources_range": _top(f"timestamp BETWEEN {START} AND {END}"),
    "top10_shared_names": _top(f"timestamp BETWEEN {START} AND {END}", SHARED),
    "top10_modulo_ties": _top(f"timestamp BETWEEN {START} AND {END}", order="id % 7, hit DESC"),
    "user_journey": f"WITH {EV} SELECT timestamp, event_type, device_id, app_id, resource_id, location, seq, {UTC} AS time_utc FROM ev WHERE user_id = '{USER}' AND timestamp BETWEEN {START} AND {END}",
    "resource_history": f"WITH {EV} SELECT timestamp, event_type, user_id, device_id, app_id, location, seq, {UTC} AS time_utc FROM ev WHERE resource_id = '{RESOURCE}' AND timestamp BETWEEN 0 AND 2000000000",
    "device_history": f"WITH {EV} SELECT timestamp, event_type, user_id, app_id, resource_id, location, seq FROM ev WHERE device_id = 'D00005' AND timestamp BETWEEN {START} AND {END}",
    "app_history": f"WITH {EV} SELECT timestamp, event_type, user_id, device_id, resource_id, location, seq FROM ev WHERE app_id = 'APP0007' AND timestamp BETWEEN {START} AND {END}",
    "log_without_user": f"WITH {EV} SELECT * FROM ev WHERE user_id <> '{USER}'",
    "time_range_filter": f"WITH {EV} SELECT * FROM ev WHERE timestamp BETWEEN {START} AND {END}",
    "dedup_rows": f"WITH {EV}, u AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (seq + 10000000 AS seq) FROM ev WHERE seq % 7 = 0) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id, device_id, app_id, resource_id, event_type, location, timestamp ORDER BY seq) = 1",
    "dictionary_ranks": f"WITH {EV}, u AS (SELECT user_id AS value, seq * 4 AS pos FROM ev UNION ALL SELECT device_id, seq * 4 + 1 FROM ev UNION ALL SELECT app_id, seq * 4 + 2 FROM ev UNION ALL SELECT resource_id, seq * 4 + 3 FROM ev), f AS (SELECT value, min(pos) AS pos FROM u GROUP BY value) SELECT value, row_number() OVER (ORDER BY pos) - 1 AS id FROM f",
    "default_keys": f"WITH {EV} SELECT user_id, resource_id FROM ev WHERE seq = (SELECT min(seq) FROM ev)",
    "local_hour": f"WITH {EV} SELECT {HOUR} AS hour, count(*) AS events FROM ev GROUP BY 1",
    "epoch_format": f"WITH {EV} SELECT seq, {UTC} AS time_utc FROM ev",
    "row_count": f"WITH {EV} SELECT count(*) AS events FROM ev",
    **{f"rule_{name.lower()}": sql for name, sql in RULE_SQL.items()},
    **{f"rule_{name.lower()}_time_order": sql for name, sql in TIME_ORDER_SQL.items()},
    "anomalies_all": f"SELECT * FROM {ALL}",
    "report_by_type": f"SELECT anomaly_type, count(*) AS alerts FROM {ALL} GROUP BY anomaly_type",
    "report_by_severity": f"SELECT s.severity, count(a.seq) AS alerts FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity) LEFT JOIN {ALL} a ON a.severity = s.severity GROUP BY s.severity",
    "report_top5_users": f"WITH {EV}, n AS (SELECT user_id, count(*) AS alerts FROM {ALL} GROUP BY user_id) SELECT row_number() OVER (ORDER BY alerts DESC, r) AS rank, n.user_id, alerts FROM n JOIN ({FIRST}) f ON n.user_id = f.user_id QUALIFY rank <= 5",
    "report_total": f"SELECT count(*) AS alerts FROM {ALL}",
    "report_emission_order": f"WITH {EV} SELECT row_number() OVER (ORDER BY f.r, a.timestamp, a.seq, rule_ord, fire_no) - 1 AS place, {UTC.replace('timestamp *', 'a.timestamp *')} AS timestamp, a.user_id, device_id, anomaly_type, severity FROM {ALL} a JOIN ({FIRST}) f ON a.user_id = f.user_id",
}
ORACLES |= ingest_contract.oracles(
    "(" + " UNION ALL ".join(f"SELECT * FROM ({TIME_ORDER_SQL.get(name, sql)})" for name, sql in RULE_SQL.items()) + ")",
    ORACLES["report_emission_order"], ORACLES["report_by_severity"], ORACLES["report_by_type"], ORACLES["report_top5_users"], ORACLES["report_total"],
)
