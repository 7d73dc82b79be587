"""A plain sequential version of the fourteen rules, for tests."""

from collections import defaultdict, deque


class Tail:
    def __init__(self, k):
        self.rows = deque(maxlen=k)

    def within(self, k, seconds):
        return len(self.rows) == k and self.rows[-1][0] - self.rows[0][0] <= seconds

    def different(self):
        return len({v for _, v in self.rows})


def simulate(events, device_order="reference"):
    """events: dicts in file order with seq. Returns a sorted list of (seq, rule, fire_no)."""
    rank, out = {}, []
    for e in events:
        rank.setdefault(e["user_id"], len(rank))
    users = defaultdict(list)
    for e in events:
        users[e["user_id"]].append(e)
    lines = [sorted(users[u], key=lambda e: (e["timestamp"], e["seq"])) for u in sorted(users, key=rank.get)]
    for line in lines:
        fails, hops, moves, logins, thefts, apps = Tail(5), Tail(3), Tail(10), Tail(3), Tail(5), Tail(4)
        last = last_place = None
        opened, start, danger, run, wake, woken = False, 0, 0, 0, None, 0
        hours = theft = lateral = False
        for e in line:
            ts, kind, place, seq = e["timestamp"], e["event_type"], e["location"], e["seq"]
            hour = (ts + 25200) % 86400 // 3600
            fire = 0

            def alert(rule, n=1, seq=seq):
                out.append((seq, rule, n))

            def long(ts=ts):
                nonlocal opened, fire
                if ts - start > 86400:
                    fire += 1
                    alert("LONG_SESSION", fire)
                    opened = False

            if kind == "LOGIN":
                if opened:
                    long()
                opened, start, danger = True, ts, 0
            if kind == "FAILED_LOGIN":
                fails.rows.append((ts, None))
                if fails.within(5, 300):
                    alert("BRUTE_FORCE")
                    fails.rows.clear()
            if kind == "LOGIN":
                hops.rows.append((ts, e["device_id"]))
                if hops.within(3, 600) and hops.different() == 3:
                    alert("DEVICE_HOPPING")
                    hops.rows.clear()
            if not hours and (hour < 6 or hour >= 22):
                hours = True
                alert("OUT_OF_HOURS")
            if last is not None and "US" not in (last_place, place) and last_place != place and ts - last < 7200:
                alert("IMPOSSIBLE_TRAVEL")
            if place != "US" and place != last_place:
                moves.rows.append((ts, place))
                if moves.within(10, 172800) and moves.different() >= 3:
                    alert("MULTI_COUNTRY_HOPPING")
                    moves.rows.clear()
            if opened:
                long()
                if kind in ("ADMIN_ACTION", "DOWNLOAD"):
                    danger += 1
                    if danger == 3:
                        alert("DANGER_CHAIN")
                        danger = 0
            if kind == "LOGIN":
                logins.rows.append((ts, None))
                if logins.within(3, 600):
                    alert("RAPID_SESSION")
                    logins.rows.clear()
            if kind == "LOGOUT":
                long()
                opened = False
            if kind == "FAILED_LOGIN":
                run += 1
            else:
                if kind == "LOGIN" and run >= 5:
                    alert("BRUTE_FORCE_SUCCESS")
                run = 0
            if last is not None and ts - last > 864000:
                wake, woken = ts, 0
            if wake is not None:
                woken += 1
                if woken == 20 and ts - wake <= 600:
                    alert("DORMANT_ACCOUNT")
            if kind == "DOWNLOAD" and hour < 6 and not theft:
                thefts.rows.append((ts, e["resource_id"]))
                if thefts.within(5, 600) and thefts.different() == 5:
                    theft = True
                    alert("DATA_EXFILTRATION")
            if not lateral:
                apps.rows.append((ts, e["app_id"]))
                if apps.within(4, 120) and apps.different() == 4:
                    lateral = True
                    alert("LATERAL_MOVEMENT")
            last, last_place = ts, place
    flat = [e for line in lines for e in line]
    if device_order == "time":
        flat.sort(key=lambda e: (e["timestamp"], e["seq"]))
    scans, takes, done = defaultdict(lambda: Tail(10)), defaultdict(lambda: Tail(3)), set()
    for e in flat:
        d = e["device_id"]
        scans[d].rows.append((e["timestamp"], e["resource_id"]))
        if scans[d].within(10, 300) and scans[d].different() == 10:
            out.append((e["seq"], "RESOURCE_SCAN", 1))
            scans[d].rows.clear()
        if e["event_type"] == "LOGIN" and d not in done:
            takes[d].rows.append((e["timestamp"], e["user_id"]))
            if takes[d].within(3, 300) and takes[d].different() == 3:
                done.add(d)
                out.append((e["seq"], "COMPROMISED_DEVICE", 1))
    return sorted(out)
