"""The fourteen rules over an access log, in one pass of windows a key.

All rules of users read one sorted sequence of a user's events: one exchange, one sort, and
windows of a single partitioning and order, whatever the number of rules. Those of devices
do the same by device. Rows of a rule's own kind among the others (the last three logins,
say) come from offsets that skip nulls, so no rule needs a sequence of its own.

The windows mark hits. Hits of rules that fire at every hit, or once, are alerts as they are;
rules that re-arm after an alert thin theirs out (`greedy_gap`). Hits are stored before, so
the windows run once.

Users' rows are ordered by (timestamp, seq). Rules of a device keep their state in the order
users come in, users by their place in the dictionary, unless device_order is "time".
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.timeparse import local_hour
from tracewarden.operators.patterns import dictionary_places, greedy_gap
from tracewarden.schema import DEFAULTS, HOME, SEVERITY, Thresholds
from tracewarden.sources.scratch import durable

RULES = tuple(SEVERITY)
ON_DEVICES = ("RESOURCE_SCAN", "COMPROMISED_DEVICE")
ALERT = ("seq", "timestamp", "user_id", "device_id", "anomaly_type", "severity", "rule_ord", "fire_no")


@dataclass(frozen=True)
class Sequence:
    """Window functions over one key's rows in one order."""

    key: str
    order: tuple[str, ...]

    def over(self, call: str, frame: str = "") -> Column:
        return F.expr(f"{call} OVER (PARTITION BY {self.key} ORDER BY {', '.join(self.order)} {frame})")

    def so_far(self, call: str) -> Column:
        return self.over(call, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

    def before(self, call: str) -> Column:
        return self.over(call, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")

    def back(self, value: str, where: str, k: int) -> Column:
        """The value k rows back among the rows where a condition holds, as seen from one of them."""
        return self.over(f"lag(IF({where}, {value}, NULL), {k}) IGNORE NULLS") if k else F.expr(value)

    def within(self, where: str, k: int, seconds: int) -> Column:
        """The last k rows where a condition holds, this one included, lie within `seconds`. In an order that isn't time's a negative span counts as within."""
        return F.coalesce(F.expr(where) & (F.col("timestamp") - self.back("timestamp", where, k - 1) <= seconds), F.lit(False))

    def values(self, value: str, where: str, k: int) -> Column:
        """Different values among the last k rows where a condition holds."""
        return F.size(F.array_distinct(F.array_compact(F.array(*[self.back(value, where, j) for j in range(k)]))))


USER = Sequence("user_id", ("timestamp", "seq"))


@dataclass(frozen=True)
class Hits:
    """Marks of a rule: where it hits, its place among an event's alerts, which alert of the event, rows to re-arm (0: none), and for that the row's number and that of its run of hits."""

    rule: str
    hit: Column
    order: Column
    fire: Column
    gap: int = 0
    at: Column | None = None
    run: Column | None = None


def with_runs(rows: DataFrame, by: Sequence, hits: dict[str, str]) -> DataFrame:
    """rows with `<hit>_run` for columns of hits: a row's number less the hits so far is the same all along a run of hits."""
    return rows.withColumns({f"{hit}_run": F.col(at) - by.so_far(f"count_if({hit})") for hit, at in hits.items()})


def user_marks(rows: DataFrame, t: Thresholds, only: frozenset[str]) -> tuple[DataFrame, list[Hits]]:
    """rows with the columns that the rules asked for need, and their marks. Steps follow each other only where windows read windows."""
    hour = local_hour(F.col("timestamp"), t.utc_offset)
    night = "event_type = 'DOWNLOAD' AND _early"
    failed, login = "event_type = 'FAILED_LOGIN'", "event_type = 'LOGIN'"
    rows = rows.withColumns({"_early": F.coalesce(hour < t.exfiltration_hour, F.lit(False)), "_outside": F.coalesce((hour < t.work_hours[0]) | (hour >= t.work_hours[1]), F.lit(False))})
    first: dict[str, Column] = {"_n": USER.over("row_number()"), "_place": USER.over("lag(location)"), "_ts": USER.over("lag(timestamp)")}
    second: dict[str, Column] = {}
    third: dict[str, Column] = {}
    marks: list[Hits] = []

    def mark(rule: str, hit: Column, order: int | Column, fire: int | Column = 1) -> None:
        order, fire = (F.lit(x) if isinstance(x, int) else x for x in (order, fire))
        marks.append(Hits(rule, hit, order, fire))

    runs: dict[str, str] = {}

    def rearming(rule: str, hit: str, order: int, gap: int, at: str) -> None:
        runs[hit] = at
        marks.append(Hits(rule, F.col(hit), F.lit(order), F.lit(1), gap, F.col(at), F.col(f"{hit}_run")))

    if "BRUTE_FORCE" in only:
        k, seconds = t.brute_force
        first |= {"_fails": USER.so_far(f"count_if({failed})"), "_forced": USER.within(failed, k, seconds)}
        rearming("BRUTE_FORCE", "_forced", 1, k, "_fails")
    if only & {"DEVICE_HOPPING", "RAPID_SESSION"}:
        first["_logins"] = USER.so_far(f"count_if({login})")
    if "DEVICE_HOPPING" in only:
        k, seconds = t.device_hopping
        first["_hopped"] = USER.within(login, k, seconds) & (USER.values("device_id", login, k) >= k)
        rearming("DEVICE_HOPPING", "_hopped", 2, k, "_logins")
    if "OUT_OF_HOURS" in only:
        first["_out"] = USER.so_far("count_if(_outside)")
        mark("OUT_OF_HOURS", F.col("_outside") & (F.col("_out") == 1), 4)
    if "IMPOSSIBLE_TRAVEL" in only:
        moved = (F.col("_place") != HOME) & (F.col("location") != HOME) & (F.col("_place") != F.col("location"))
        mark("IMPOSSIBLE_TRAVEL", moved & (F.col("timestamp") - F.col("_ts") < t.travel_seconds), 5)
    if "MULTI_COUNTRY_HOPPING" in only:
        k, seconds = t.country_changes
        moved = f"location <> '{HOME}' AND (_place IS NULL OR _place <> location)"
        second |= {"_moves": USER.so_far(f"count_if({moved})"), "_toured": USER.within(moved, k, seconds) & (USER.values("location", moved, k) >= t.countries)}
        rearming("MULTI_COUNTRY_HOPPING", "_toured", 6, k, "_moves")
    if only & {"LONG_SESSION", "DANGER_CHAIN"}:
        # the latest edge before the row says whether a session is open; rows are in time order, so the latest login's time is the greatest
        first["_edge"] = USER.before("last(IF(event_type IN ('LOGIN', 'LOGOUT'), event_type, NULL), true)")
        first["_start"] = F.coalesce(USER.before(f"max(IF({login}, timestamp, NULL))"), F.lit(0))
        is_open = F.coalesce((F.col("_edge") == "LOGIN") & (F.col("_ts") - F.col("_start") <= t.session_seconds), F.lit(False))
        second["_open"] = is_open
    if "LONG_SESSION" in only:
        # found open too long; once more at a logout, open session or not
        over = F.col("timestamp") - F.col("_start") > t.session_seconds
        mark("LONG_SESSION", over & F.col("_open"), F.when(F.expr(login), 0).otherwise(7))
        mark("LONG_SESSION", over & (F.col("event_type") == "LOGOUT"), 10, F.when(F.col("_open"), 2).otherwise(1))
    if "DANGER_CHAIN" in only:
        bad = is_open & F.col("event_type").isin("ADMIN_ACTION", "DOWNLOAD")
        second["_bad"] = bad
        third |= {"_dangers": USER.so_far("count_if(_bad)"), "_fresh": USER.so_far(f"count_if({login})")}
    if "RAPID_SESSION" in only:
        k, seconds = t.rapid_session
        first["_rapid"] = USER.within(login, k, seconds)
        rearming("RAPID_SESSION", "_rapid", 9, k, "_logins")
    if "BRUTE_FORCE_SUCCESS" in only:
        second["_other"] = F.coalesce(USER.before(f"max(IF({failed}, NULL, _n))"), F.lit(0))
        mark("BRUTE_FORCE_SUCCESS", F.expr(login) & (F.col("_n") - 1 - F.col("_other") >= t.failures_before_login), 11)
    if "DORMANT_ACCOUNT" in only:
        k, seconds = t.dormant_burst
        woke = f"timestamp - _ts > {t.dormant_seconds}"
        second |= {"_woken": USER.so_far(f"max(IF({woke}, _n, NULL))"), "_since": USER.so_far(f"max(IF({woke}, timestamp, NULL))")}
        mark("DORMANT_ACCOUNT", (F.col("_n") - F.col("_woken") + 1 == k) & (F.col("timestamp") - F.col("_since") <= seconds), 12)
    if "DATA_EXFILTRATION" in only:
        k, seconds = t.exfiltration
        first["_drained"] = USER.within(night, k, seconds) & (USER.values("resource_id", night, k) >= k)
        second["_drains"] = USER.so_far("count_if(_drained)")
        mark("DATA_EXFILTRATION", F.col("_drained") & (F.col("_drains") == 1), 13)
    if "LATERAL_MOVEMENT" in only:
        k, seconds = t.lateral_movement
        first["_spread"] = USER.within("true", k, seconds) & (USER.values("app_id", "true", k) >= k)
        second["_spreads"] = USER.so_far("count_if(_spread)")
        mark("LATERAL_MOVEMENT", F.col("_spread") & (F.col("_spreads") == 1), 15)
    rows = rows.withColumns(first)
    if second:
        rows = rows.withColumns(second)
    if third:
        rows = rows.withColumns(third)
        # dangers before the latest login, itself included: it is none
        rows = rows.withColumn("_before", F.coalesce(USER.so_far(f"max(IF({login}, _dangers, NULL))"), F.lit(0)))
        mark("DANGER_CHAIN", F.col("_bad") & ((F.col("_dangers") - F.col("_before")) % t.danger_actions == 0), 8)
    return with_runs(rows, USER, runs) if runs else rows, marks


def device_marks(rows: DataFrame, t: Thresholds, only: frozenset[str], order: tuple[str, ...]) -> tuple[DataFrame, list[Hits]]:
    """rows with the columns that the rules of devices need, and their marks."""
    device, login = Sequence("device_id", order), "event_type = 'LOGIN'"
    marks: list[Hits] = []
    if "RESOURCE_SCAN" in only:
        k, seconds = t.resource_scan
        rows = rows.withColumns({"_n": device.over("row_number()"), "_scanned": device.within("true", k, seconds) & (device.values("resource_id", "true", k) >= k)})
        rows = with_runs(rows, device, {"_scanned": "_n"})
        marks.append(Hits("RESOURCE_SCAN", F.col("_scanned"), F.lit(3), F.lit(1), k, F.col("_n"), F.col("_scanned_run")))
    if "COMPROMISED_DEVICE" in only:
        k, seconds = t.compromised_device
        rows = rows.withColumn("_shared", device.within(login, k, seconds) & (device.values("user_id", login, k) >= k))
        rows = rows.withColumn("_shares", device.so_far("count_if(_shared)"))
        marks.append(Hits("COMPROMISED_DEVICE", F.col("_shared") & (F.col("_shares") == 1), F.lit(14), F.lit(1)))
    return rows, marks


def hits_of(rows: DataFrame, marks: list[Hits], key: str) -> DataFrame:
    """One row a hit: an alert's columns, `_key`, `_gap`, `_i` and `_run`."""
    none = F.lit(None).cast("long")
    found = [
        F.when(
            m.hit,
            F.struct(
                F.lit(m.rule).alias("anomaly_type"),
                F.lit(SEVERITY[m.rule]).alias("severity"),
                m.order.cast("int").alias("rule_ord"),
                m.fire.cast("int").alias("fire_no"),
                F.lit(m.gap).cast("int").alias("_gap"),
                (none if m.at is None else m.at.cast("long")).alias("_i"),
                (none if m.run is None else m.run.cast("long")).alias("_run"),
            ),
        )
        for m in marks
    ]
    some = reduce(Column.__or__, [F.coalesce(m.hit, F.lit(False)) for m in marks])
    rows = rows.filter(some).select("seq", "timestamp", "user_id", "device_id", F.col(key).alias("_key"), F.explode(F.array_compact(F.array(*found))).alias("h"))
    return rows.select("seq", "timestamp", "user_id", "device_id", "_key", "h.*")


def detect(events: DataFrame, t: Thresholds = DEFAULTS, device_order: str = "reference", only: tuple[str, ...] = RULES) -> DataFrame:
    """All alerts of the rules named, one row each; an event may give LONG_SESSION twice."""
    if device_order not in ("reference", "time"):
        raise ValueError(f"device_order is 'reference' or 'time', not {device_order!r}")
    if unknown := set(only) - set(RULES):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    asked, found = frozenset(only), []
    if mine := asked - set(ON_DEVICES):
        found.append(hits_of(*user_marks(events, t, mine), "user_id"))
    if mine := asked & set(ON_DEVICES):
        rows, order = events, ("timestamp", "seq")
        if device_order == "reference":
            rows, order = events.join(dictionary_places(events, "user_id", "_user_rank"), "user_id"), ("_user_rank", *order)
        found.append(hits_of(*device_marks(rows, t, mine, order), "device_id"))
    hits = durable(reduce(DataFrame.unionByName, found), "hits")
    at_once = hits.filter("_gap = 0")
    thinned = greedy_gap(hits.filter("_gap > 0"), ["anomaly_type", "_key"], "_gap")
    return at_once.select(*ALERT).unionByName(thinned.select(*ALERT))


def rule(name: str):
    """The function that runs one rule."""

    def run(events: DataFrame, t: Thresholds = DEFAULTS, device_order: str = "reference") -> DataFrame:
        return detect(events, t, device_order, (name,))

    return run
