"""Row types, fixed value sets and thresholds of access-log analytics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The columns of the log file, the event types and the locations, in their order.
FIELDS = ("user_id", "device_id", "app_id", "resource_id", "event_type", "location", "timestamp")
HEADER = ",".join(FIELDS)
EVENT_TYPES = ("LOGIN", "LOGOUT", "TOKEN_REFRESH", "ACCESS", "FAILED_LOGIN", "OPEN_APP", "DOWNLOAD", "ADMIN_ACTION")
LOCATIONS = ("US", "VN", "JP", "KR", "SG", "CN", "DE", "FR", "UK", "AU", "CA", "IN", "BR", "RU", "TH")
HOME = "US"  # movements to and from it are invisible to the travel rules

EVENTS = T.StructType([T.StructField(c, T.StringType(), False) for c in FIELDS[:-1]] + [T.StructField("timestamp", T.LongType(), False), T.StructField("seq", T.LongType(), False)])

# Rule names and their severities.
SEVERITY = {
    "BRUTE_FORCE": "MEDIUM",
    "DEVICE_HOPPING": "MEDIUM",
    "RESOURCE_SCAN": "HIGH",
    "OUT_OF_HOURS": "LOW",
    "IMPOSSIBLE_TRAVEL": "CRITICAL",
    "MULTI_COUNTRY_HOPPING": "HIGH",
    "LONG_SESSION": "MEDIUM",
    "DANGER_CHAIN": "HIGH",
    "RAPID_SESSION": "MEDIUM",
    "BRUTE_FORCE_SUCCESS": "CRITICAL",
    "DORMANT_ACCOUNT": "CRITICAL",
    "DATA_EXFILTRATION": "CRITICAL",
    "COMPROMISED_DEVICE": "HIGH",
    "LATERAL_MOVEMENT": "MEDIUM",
}
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


# The rules' thresholds.
@dataclass(frozen=True)
class Thresholds:
    """How many events within how many seconds make each rule fire."""

    brute_force: tuple[int, int] = (5, 300)
    device_hopping: tuple[int, int] = (3, 600)
    resource_scan: tuple[int, int] = (10, 300)
    work_hours: tuple[int, int] = (6, 22)
    travel_seconds: int = 7200
    country_changes: tuple[int, int] = (10, 172_800)
    countries: int = 3
    session_seconds: int = 86_400
    danger_actions: int = 3
    rapid_session: tuple[int, int] = (3, 600)
    failures_before_login: int = 5
    dormant_seconds: int = 864_000
    dormant_burst: tuple[int, int] = (20, 600)
    exfiltration: tuple[int, int] = (5, 600)
    exfiltration_hour: int = 6
    compromised_device: tuple[int, int] = (3, 300)
    lateral_movement: tuple[int, int] = (4, 120)
    utc_offset: int = 25_200  # rules look at the hour of this zone


DEFAULTS = Thresholds()
EARLIEST, LATEST = 0, 2_000_000_000  # the range that "all" stands for in interactive use
