import random

import pytest

from tests.simulator import simulate
from tracewarden.operators.rules import RULES, detect
from tracewarden.schema import EVENT_TYPES, EVENTS, LOCATIONS


def event(seq, ts, kind="ACCESS", user="u", device="d", app="a", resource="r", place="US"):
    return {"user_id": user, "device_id": device, "app_id": app, "resource_id": resource, "event_type": kind, "location": place, "timestamp": ts, "seq": seq}


def run(spark, events, device_order="reference"):
    df = spark.createDataFrame([tuple(e[c] for c in EVENTS.names) for e in events], EVENTS)
    return sorted((r["seq"], r["anomaly_type"], r["fire_no"]) for r in detect(df, device_order=device_order).collect())


def noise(rnd, n, users, hot):
    ts, out = 1_700_000_000, []
    kinds = EVENT_TYPES if not hot else ("FAILED_LOGIN", "LOGIN", "FAILED_LOGIN", "DOWNLOAD", "LOGOUT")
    for seq in range(n):
        ts += rnd.choice((0, 1, 5, 20, 60, 60, 200, 400, 90_000 if rnd.random() < 0.3 else 3, 870_000 if rnd.random() < 0.1 else 2))
        out.append(event(seq, ts - rnd.choice((0, 0, 0, 50)), rnd.choice(kinds), f"u{rnd.randrange(users)}", f"d{rnd.randrange(3)}", f"a{rnd.randrange(6)}", f"r{rnd.randrange(40)}", rnd.choice(LOCATIONS[:4])))
    return out


def test_random_logs_match_the_sequential_version(spark):
    """Many small logs side by side, users and devices apart by name."""
    rnd, events, expected = random.Random(5), [], {"reference": [], "time": []}
    for log in range(12):
        own = noise(rnd, 160, rnd.choice((1, 2, 4)), log % 2)
        for e in own:
            e["seq"] += log * 1000
            e["user_id"], e["device_id"] = f"{log}-{e['user_id']}", f"{log}-{e['device_id']}"
        events += own
    for order in expected:
        assert run(spark, events, order) == simulate(events, order)
    fired = {r for _, r, _ in simulate(events)}
    assert len(fired) >= 11, set(RULES) - fired


@pytest.fixture(scope="module")
def cases(spark):
    """Hand-made boundary cases, all in one run: name -> alerts."""
    day = 1_700_006_400 // 86_400 * 86_400  # 07:00 at UTC+7
    noon, two = day + 5 * 3600, day + 19 * 3600
    make = {
        "fails 300": [(noon + t, {"kind": "FAILED_LOGIN"}) for t in (0, 75, 150, 225, 300)],
        "fails 301": [(noon + t, {"kind": "FAILED_LOGIN"}) for t in (0, 75, 150, 225, 301)],
        "nine fails": [(noon + 30 * t, {"kind": "FAILED_LOGIN"}) for t in range(9)],
        "hop": [(noon + 300 * k, {"kind": "LOGIN", "device": f"h{k}"}) for k in range(3)],
        "no hop": [(noon + 100 * k, {"kind": "LOGIN", "device": f"n{k % 2}"}) for k in range(4)],
        "scan": [(noon + 33 * k, {"device": "s", "resource": f"r{k}"}) for k in range(10)],
        "no scan": [(noon + 3 * k, {"device": "ns", "resource": f"r{k % 9}"}) for k in range(11)],
        "05:59:59": [(day - 3600 - 1, {})],
        "06:00:00": [(day - 3600, {})],
        "21:59:59": [(day + 15 * 3600 - 1, {})],
        "22:00:00": [(day + 15 * 3600, {}), (day + 15 * 3600 + 1, {})],
        "travel 7199": [(noon, {"place": "VN"}), (noon + 7199, {"place": "JP"})],
        "travel 7200": [(noon, {"place": "VN"}), (noon + 7200, {"place": "JP"})],
        "travel US": [(noon, {"place": "VN"}), (noon + 10, {"place": "US"}), (noon + 20, {"place": "JP"})],
        "ten moves": [(noon + 8000 * k % 30_000 + 86_400 * (k // 4), {"place": ("VN", "JP", "KR")[k % 3]}) for k in range(10)],
        "long twice": [(noon, {"kind": "LOGIN"}), (noon + 86_401, {"kind": "LOGOUT"})],
        "long not": [(noon, {"kind": "LOGIN"}), (noon + 86_400, {"kind": "LOGOUT"})],
        "orphan": [(noon, {"kind": "LOGOUT"})],
        "danger": [(noon, {"kind": "LOGIN"}), *[(noon + k, {"kind": "DOWNLOAD"}) for k in range(1, 7)]],
        "no danger": [(noon + k, {"kind": "ADMIN_ACTION"}) for k in range(6)],
        "rapid": [(noon + 300 * k, {"kind": "LOGIN"}) for k in range(4)],
        "success": [*[(noon + 400 * k, {"kind": "FAILED_LOGIN"}) for k in range(5)], (noon + 5000, {"kind": "LOGIN"})],
        "no success": [*[(noon + 400 * k, {"kind": "FAILED_LOGIN"}) for k in range(5)], (noon + 4000, {}), (noon + 5000, {"kind": "LOGIN"})],
        "dormant": [(noon, {}), *[(noon + 864_001 + 30 * k, {}) for k in range(20)]],
        "nineteen": [(noon, {}), *[(noon + 864_001 + 30 * k, {}) for k in range(19)]],
        "not dormant": [(noon, {}), *[(noon + 864_000 + 30 * k, {}) for k in range(20)]],
        "theft": [(two + 150 * k, {"kind": "DOWNLOAD", "resource": f"t{k}"}) for k in range(5)],
        "late": [(day + 16 * 3600 + 10 * k, {"kind": "DOWNLOAD", "resource": f"t{k}"}) for k in range(5)],
        "lateral": [*[(noon + 40 * k, {"app": f"a{k}"}) for k in range(4)], *[(noon + 500 + 40 * k, {"app": f"a{k}"}) for k in range(4)]],
        "no lateral": [(noon + t, {"app": f"a{t}"}) for t in (0, 40, 80, 121)],
    }
    events, names = [], {}
    for name, rows in make.items():
        for ts, more in rows:
            names[len(events)] = name
            events.append(event(len(events), ts, **{"user": name, "device": f"dev {name}", **more}))
    for k, user in enumerate(("c1", "c2", "c3", "c4")):
        names[len(events)] = "device"
        events.append(event(len(events), noon + 100 * k, "LOGIN", user, "shared"))
    found = {n: [] for n in [*make, "device"]}
    for seq, rule, _ in run(spark, events):
        found[names[seq]].append(rule)
    return found


@pytest.mark.parametrize(
    "name, rule, times",
    [
        ("fails 300", "BRUTE_FORCE", 1), ("fails 301", "BRUTE_FORCE", 0), ("nine fails", "BRUTE_FORCE", 1),
        ("hop", "DEVICE_HOPPING", 1), ("no hop", "DEVICE_HOPPING", 0), ("scan", "RESOURCE_SCAN", 1), ("no scan", "RESOURCE_SCAN", 0),
        ("05:59:59", "OUT_OF_HOURS", 1), ("06:00:00", "OUT_OF_HOURS", 0), ("21:59:59", "OUT_OF_HOURS", 0), ("22:00:00", "OUT_OF_HOURS", 1),
        ("travel 7199", "IMPOSSIBLE_TRAVEL", 1), ("travel 7200", "IMPOSSIBLE_TRAVEL", 0), ("travel US", "IMPOSSIBLE_TRAVEL", 0),
        ("long twice", "LONG_SESSION", 2), ("long not", "LONG_SESSION", 0), ("orphan", "LONG_SESSION", 1),
        ("danger", "DANGER_CHAIN", 2), ("no danger", "DANGER_CHAIN", 0), ("rapid", "RAPID_SESSION", 1),
        ("success", "BRUTE_FORCE_SUCCESS", 1), ("no success", "BRUTE_FORCE_SUCCESS", 0),
        ("dormant", "DORMANT_ACCOUNT", 1), ("nineteen", "DORMANT_ACCOUNT", 0), ("not dormant", "DORMANT_ACCOUNT", 0),
        ("theft", "DATA_EXFILTRATION", 1), ("late", "DATA_EXFILTRATION", 0),
        ("lateral", "LATERAL_MOVEMENT", 1), ("no lateral", "LATERAL_MOVEMENT", 0), ("device", "COMPROMISED_DEVICE", 1),
    ],
)
def test_boundaries(cases, name, rule, times):
    assert cases[name].count(rule) == times


def test_a_storm_of_alerts_is_one_run(spark):
    events = [event(k, 1_700_000_000 + k, "FAILED_LOGIN") for k in range(1003)]
    found = [s for s, r, _ in run(spark, events) if r == "BRUTE_FORCE"]
    assert found == list(range(4, 1003, 5))


def test_empty_log(spark):
    assert run(spark, []) == []
